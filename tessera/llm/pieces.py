"""SentencePiece encoding and decoding with a table of distinct chunks.

In the models taken here no piece has anything before a white space marker but other markers. A chunk is
a run of markers with what follows it, so no merge crosses chunks: each distinct chunk of the corpus is
segmented once and a text's ids are its chunks' ids in the order of their places.

Texts are dealt once, compressed, to batches. A batch sends its distinct chunks, packed, to as many ranges
of their hashes; there each is segmented once, and its ids go back to the batches that asked, in the order
in which they did, so that chunks don't travel again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .common import BATCH_BYTES, id_text, partitions, text_bytes
from .tokens import slices

MARK = "▁"
_ODD = re.compile(f"  |^ | $|^$|{MARK}")
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Texts that are put together at a time.
SLICE = 64


class Chunks:
    """What a model makes of chunks, and how texts are cut into them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces of this model cross white space markers, for one {crossing[0]!r}")

    @staticmethod
    def cut(text: str) -> list[str]:
        """A text's chunks. It gets a marker in front, which a chunk gives up as the model puts it there again."""
        if not text:
            return []
        return [c[1:] for c in _CHUNK.findall(" " + text)] if _ODD.search(text) else text.split(" ")

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """An empty chunk is a marker alone, which the model makes of a space; its own prefix is the other of the two."""
        ids = self.model.encode(chunks, num_threads=1)
        return [x if c else self.model.encode("a ")[len(self.model.encode("a")) :] for c, x in zip(chunks, ids, strict=True)] if "" in chunks else ids

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids) if ids else []


@cache
def model(path: str) -> Chunks:
    """The worker's own copy of a model."""
    return Chunks(path)


def _pack(strings: list[str]) -> tuple[bytes, bytes]:
    """Strings as their lengths in bytes and their bytes, compressed."""
    import zstandard

    raw = [s.encode() for s in strings]
    return H.pack(np.array([len(r) for r in raw], "u8")), zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(lengths: bytes, body: bytes) -> list[str]:
    import zstandard

    raw, ends = zstandard.ZstdDecompressor().decompress(body), np.cumsum(H.unpack(lengths)).tolist()
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def _dealt(docs: DataFrame, batches: int, id_col: str, text_col: str) -> DataFrame:
    """batch, ids, lengths, body: a task's texts of each batch, packed, a row for each 16 MB or less of them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def out() -> pa.RecordBatch:
            packed = [(b, ids, *_pack(texts)) for b, (ids, texts) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in packed], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["batch", "ids", "lengths", "body"])

        for batch in slices(rows, 1024):
            for b, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = held.setdefault(b, ([], []))
                ids.append(doc), texts.append(text or "")
            size += batch.nbytes
            if size > 1 << 24:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    return id_text(docs, id_col, text_col).select(batch, "doc_id", "text").mapInArrow(run, "batch int, ids array<long>, lengths binary, body binary")


def _by_part(texts: list[str], parts: int) -> dict[int, list[str]]:
    """The distinct chunks of a batch, sorted, by the part of the table that each is in."""
    distinct, out = set(), {}
    for k in range(0, len(texts), SLICE):
        distinct.update(*map(Chunks.cut, texts[k : k + SLICE]))
    for c in sorted(distinct):
        out.setdefault(crc32(c.encode()) % parts, []).append(c)
    return out


def _texts(table: pa.Table) -> tuple[list[int | None], list[str]]:
    """A batch's ids and texts. Its rows are sorted, so that they stand in one order whatever task they came from."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("body", "lengths", "ids")), strict=True), key=lambda r: r[:2])
    return [i for _, _, ids in rows for i in ids], [t for body, lengths, _ in rows for t in _unpack(lengths, body)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the model's end id last) and decoded (what the model makes of the ids) of each row.

    Null text: as empty, which is the end id alone. Empty table: no rows. Repeated rows: each by itself.
    Literal markers in a text are markers, as for the model. A text without spaces is one chunk.
    """
    spark = docs.sparkSession
    batches = max(partitions(spark), -(-text_bytes(docs, text_col) // BATCH_BYTES))
    parts = -(-batches // 4)
    binary = {"lengths": pa.binary(), "body": pa.binary()}

    def ask(table: pa.Table) -> pa.Table:
        """First pass: a batch's distinct chunks, to the parts of the table."""
        by_part = _by_part(_texts(table)[1], parts)
        packed = [_pack(chunks) for chunks in by_part.values()]
        columns = {"part": pa.array(by_part, pa.int32()), "batch": pa.array([table.column("batch")[0].as_py()] * len(packed), pa.int32())}
        return pa.table(columns | {c: pa.array([p[k] for p in packed], t) for k, (c, t) in enumerate(binary.items())})

    def answer(table: pa.Table) -> pa.Table:
        """One part of the table: each chunk once, then for each batch its chunks' numbers of ids, the ids, and decoded chunks that are not as they were."""
        own, asked = model(model_path), [_unpack(*r) for r in zip(*(table.column(c).to_pylist() for c in binary), strict=True)]
        distinct = list(set().union(*asked))
        ids, odd = {}, {}
        for k in range(0, len(distinct), 4096):
            some = distinct[k : k + 4096]
            got = own.segment(some)
            ids.update(zip(some, got, strict=True))
            odd.update((c, d) for c, d in zip(some, own.decode(got), strict=True) if c != d)
        out = {"counts": [], "ids": [], "odd": [], "decoded": []}
        for chunks in asked:
            out["counts"].append(H.pack(np.array([len(ids[c]) for c in chunks], "u8"))), out["ids"].append(H.pack(np.array([i for c in chunks for i in ids[c]], "u8")))
            unlike = [k for k, c in enumerate(chunks) if c in odd]
            out["odd"].append(unlike), out["decoded"].append([odd[chunks[k]] for k in unlike])
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.table({"batch": table.column("batch"), "part": table.column("part")} | {c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    def put_together(table: pa.Table, found: pa.Table) -> pa.Table:
        """Second pass: a text's ids are those of its chunks, by their places."""
        own, (names, texts) = model(model_path), _texts(table)
        known, decoded, by_part = {}, {}, _by_part(texts, parts)
        for part, counts, ids, odd, unlike in zip(*(found.column(c).to_pylist() for c in ("part", "counts", "ids", "odd", "decoded")), strict=True):
            raw, ends = H.unpack(ids).astype("<i4").tobytes(), (4 * np.cumsum(H.unpack(counts).astype("i8"))).tolist()
            known.update(zip(by_part[part], (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            decoded.update((by_part[part][k], d) for k, d in zip(odd, unlike, strict=True))
        end, rows, back = np.array([own.model.eos_id()], "<i4").tobytes(), [], []
        for t in texts:
            cut = Chunks.cut(t)
            rows.append(b"".join(map(known.__getitem__, cut)) + end)
            if MARK in t or any(map(decoded.__contains__, cut)) or _ODD.search(t):
                back.append(own.model.decode(np.frombuffer(rows[-1], "<i4").tolist()))
            else:
                back.append(t)  # each chunk comes back as it was, and the marker between two as a space
        offsets = pa.array(np.cumsum([0] + [len(r) // 4 for r in rows]), pa.int32())
        values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(rows))])
        return pa.table({"doc_id": pa.array(names, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, values), "decoded": pa.array(back, pa.string())})

    dealt = _dealt(docs, batches, id_col, text_col).groupBy("batch")
    asked = dealt.applyInArrow(ask, "part int, batch int, lengths binary, body binary")
    answers = asked.groupBy("part").applyInArrow(answer, "batch int, part int, counts binary, ids binary, odd array<int>, decoded array<string>")
    return dealt.cogroup(answers.groupBy("batch")).applyInArrow(put_together, "doc_id long, ids array<int>, decoded string")
