"""Words of many texts at once, cut in NumPy from their UTF-8 bytes. What ends a word is ASCII, so no character is cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at a time.
SEGMENT = 4 << 20


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts, one after another, and where each begins; the end last."""
    kind = "i8" if pa.types.is_large_string(texts.type) else "i4"
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    return np.frombuffer(data, "u1")[at[0] : at[-1]] if data is not None else np.zeros(0, "u1"), at - at[0]


def first_bytes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a text begins at a byte."""
    first = np.zeros(len(data), bool)
    first[begins[begins < len(data)]] = True
    return first


def words_at(data: np.ndarray, first: np.ndarray, gap: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of adjacent texts and where each begins; gap: for every byte value whether it is between words."""
    inside = ~gap[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(head)
    places = np.cumsum(inside)
    offsets = np.append(places[starts] - 1, places[-1] if len(places) else 0)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype("i8")), pa.py_buffer(data[inside])), starts


def segments(data: np.ndarray, cut: np.ndarray, segment: int) -> Iterator[np.ndarray]:
    """A long text in parts of about `segment` bytes, each ended by a byte at which cut is true."""
    at = 0
    while at < len(data):
        end = at + segment
        last = np.flatnonzero(cut[at:end])
        if end >= len(data):
            stop = len(data)
        elif len(last):
            stop = at + int(last[-1]) + 1
        else:
            stop = len(data)
            for a in range(end, len(data), segment):
                more = np.flatnonzero(cut[a : a + segment])
                if len(more):
                    stop = a + int(more[0]) + 1
                    break
        yield data[at:stop]
        at = stop


def groups(texts: pa.Array, segment: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of `segment` bytes at most, or of one longer text."""
    sizes, i = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + sizes[j] <= segment):
            total, j = total + sizes[j], j + 1
        yield i, j
        i = j
