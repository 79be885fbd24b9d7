"""Hashes of words and of runs of words, for whole slices of texts at a time, and packed lists of hashes.

All arithmetic is modulo 2^64. A word's hash is a polynomial of its bytes with a random value for each
byte; a run's is a polynomial of its mixed word hashes. Lists that are shuffled are sorted, delta-coded,
laid out in byte planes and compressed, which takes a 48-bit hash to 3 or 4 bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype="u1")
_LOWER = np.where((_SAME >= 65) & (_SAME <= 90), _SAME + 32, _SAME).astype("u1")
_VALUE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype="u8")
#: Odd bases whose differences with 1 have one factor 2.
BYTE_BASE, RUN_BASES = 0x9E3779B97F4A7C17, (0xD1342543DE82EF97, 0xAF251AF3B0F025B7)
#: Bytes of text that are hashed at a time (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def mix(z: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    z = z + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    p = np.full(1 << bits, base, "u8")
    p[0] = 1
    return np.cumprod(p)


def _of(base: int, n: int) -> np.ndarray:
    return _powers(base, max(20, int(n).bit_length()))[:n]


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and each text's number of words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", "u1")
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # word starts and ends take turns
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum(_VALUE[_LOWER[raw] if lower else raw] * _of(BYTE_BASE, len(raw)), out=sums[1:])
    inverse = pow(BYTE_BASE, -1, 1 << 64)
    hashes = mix((sums[ends] - sums[starts]) * _of(inverse, len(raw))[starts])
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, firsts))


def runs(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of the `length` words from each place on (zeros where fewer follow); texts are not told apart."""
    base, out = RUN_BASES[which], np.zeros(len(hashes), "u8")
    if len(hashes) < length:
        return out
    part, size, total, done = mix(hashes, which + 1), 1, None, 0  # part: runs of `size` words
    left = length
    while left:
        if left & 1:
            shifted = part[done:] if total is None else part[done:][: len(total)]
            factor = np.uint64(pow(base, done, 1 << 64))
            total = shifted * factor if total is None else total[: len(shifted)] + shifted * factor
            done += size
        left >>= 1
        if left:
            part, size = part[:-size] + part[size:] * np.uint64(pow(base, size, 1 << 64)), size * 2
    n = len(hashes) - length + 1
    out[:n] = mix(total[:n], length)
    return out


def starts_within(counts: np.ndarray, length: int) -> np.ndarray:
    """For each word whether `length` words of the same text begin with it."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + length <= ends


def slices(texts: list[bytes]) -> list[tuple[int, int]]:
    """Bounds of consecutive texts of about SLICE_BYTES together."""
    bounds, first, size = [], 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > SLICE_BYTES:
            bounds.append((first, k))
            first, size = k, 0
        size += len(t)
    return [*bounds, (first, len(texts))] if texts else bounds


def pack_sorted(values: np.ndarray) -> bytes:
    """An ascending row of unsigned integers: delta-coded, in byte planes, compressed."""
    return pack(np.diff(values.astype("u8"), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype="u8")


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as many byte planes as the largest needs, compressed."""
    import zstandard

    values = values.astype("<u8")
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = np.ascontiguousarray(values.view("u1").reshape(-1, 8).T[:planes]).tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = data[0]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "u1").reshape(planes, -1)
    values = np.zeros((body.shape[1], 8), "u1")
    values[:, :planes] = body.T
    return values.view("<u8").reshape(-1)
