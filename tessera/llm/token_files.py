"""Token-ID files in bit planes.

A file holds whole documents' ids. The row of ids is cut into blocks of a fixed size; a block is
transposed into byte planes (or bit planes), each plane is compressed with zstandard by itself, and a
chunk index tells where each block's planes lie, so that one block can be read alone.

Layout, little-endian: b"TPLN", then u32 version, planes of a block, ids a block, blocks, and u64
documents and ids; the size of the document table and the table (zstandard; doc ids and id counts, 8
bytes each); a u32 for each plane of each block, its compressed size; the planes.

Files are files of the shared folder, each renamed to its name when it is whole, and a manifest, a written
table, lists them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_text, new_path, partitions, staged
from .packing import task_offsets
from .tokens import AT_ONCE, encoder, slices

MAGIC, VERSION = b"TPLN", 1
HEAD = struct.Struct("<4sIIIIQQQ")
#: Ids in a block, and ids after which a file is closed (its last document stays whole).
BLOCK, FILE_IDS = 16_384, 1 << 20
LEVEL = 3
#: Stands for a null id.
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """A block's planes: 4 of bytes, or 32 of bits, the lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view("u1").reshape(-1, 4).T)
    if planes == "byte":
        return [p.tobytes() for p in octets]
    return [np.packbits((o >> k) & 1).tobytes() for o in octets for k in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, "u1") for p in planes]).T).view("<u4").reshape(-1)
    ids = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, "u1"), count=n).astype("<u4") << np.uint32(k)
    return ids


def write_file(docs: list[int], counts: list[int], ids: np.ndarray, planes: str = "byte", block: int = BLOCK, level: int = LEVEL) -> bytes:
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    blocks = [[packer.compress(p) for p in to_planes(ids[k : k + block], planes)] for k in range(0, len(ids), block)]
    table = packer.compress(np.array([docs, counts], "<i8").tobytes())
    index = np.array([len(p) for b in blocks for p in b], "<u4").tobytes()
    head = HEAD.pack(MAGIC, VERSION, 4 if planes == "byte" else 32, block, len(blocks), len(docs), len(ids), len(table))
    return b"".join([head, table, index, *(p for b in blocks for p in b)])


class TokenFile:
    """A file, opened (or its bytes); reads its tables at once and blocks one by one."""

    def __init__(self, file: BinaryIO | bytes):
        import zstandard

        self.file = file
        magic, version, self.planes, self.block, self.blocks, docs, self.n, table = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        self.unpacker, at = zstandard.ZstdDecompressor(), HEAD.size
        self.docs, self.counts = np.frombuffer(self.unpacker.decompress(self._at(at, table)), "<i8").reshape(2, docs)
        sizes = np.frombuffer(self._at(at + table, 4 * self.blocks * self.planes), "<u4").astype("i8")
        self.edges = at + table + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])

    def _at(self, start: int, size: int) -> bytes:
        if isinstance(self.file, bytes):
            return self.file[start : start + size]
        self.file.seek(int(start))
        return self.file.read(int(size))

    def read_block(self, k: int) -> np.ndarray:
        edges = self.edges[k * self.planes : (k + 1) * self.planes + 1]
        data, edges = self._at(edges[0], edges[-1] - edges[0]), edges - edges[0]
        planes = [self.unpacker.decompress(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return from_planes(planes, min(self.block, self.n - k * self.block))

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *(self.read_block(k) for k in range(self.blocks))])


def _store(folder: str):
    """The file system of a folder's URI, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:") or folder.startswith("/"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, planes: str = "byte", file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files, in ascending doc_id order, and gives their manifest: part, first (ids of the part before the file), n_ids, n_docs, path.

    A file gets its name when it is whole, so a lost task's half-written file is never seen, and the
    same name and bytes when the task is run again. Ids are sorted by range partitions; a part's files
    hold its rows in order. Null text: as empty. Null ids come first, as NO_ID in the document table.
    Rows of one id stand in the order of a hash of their texts, and may be in more than one part.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, before, number = TaskContext.get().partitionId(), encoder(tokenizer_path), 0, 0
        store, path = _store(folder)
        names, counts, ids, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            row = np.frombuffer(b"".join(ids), "<u4")
            name, unnamed = f"{path}/part-{part:06d}-{number:06d}.tpln", f"{path}/_{uuid.uuid4().hex}"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(unnamed) as out:
                out.write(write_file(names, counts, row, planes))
            store.move(unnamed, name)
            return pa.RecordBatch.from_pydict({"part": [part], "first": [before], "n_ids": [len(row)], "n_docs": [len(names)], "path": [f"{folder}/{name.rpartition('/')[2]}"]})

        for batch in slices(batches, AT_ONCE):
            for doc, x in zip(batch.column(0).to_pylist(), own.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                names.append(doc), counts.append(len(x) // 4 + 1), ids.extend((x, end))
                held += counts[-1]
                if held >= file_ids:
                    yield file()
                    names, counts, ids, before, held, number = [], [], [], before + held, 0, number + 1
        if names:
            yield file()

    return staged(rows.mapInArrow(run, "part long, first long, n_ids long, n_docs long, path string"), "manifest")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32-bit little-endian bytes), from the files of a manifest."""
    offsets = task_offsets(files, "n_ids")
    placed = files.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("offset")).alias("at"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder, _, name = name.rpartition("/")
                store, path = _store(folder)
                with store.open_input_file(f"{path}/{name}") as opened:
                    stored = TokenFile(opened)
                    ids, ends = stored.ids().tobytes(), np.cumsum(stored.counts)
                for k in range(0, len(ends), 1024):
                    some = ends[k : k + 1024]
                    starts = some - stored.counts[k : k + 1024]
                    own = [ids[4 * a : 4 * b] for a, b in zip(starts, some, strict=True)]
                    names = pa.array(stored.docs[k : k + 1024], mask=stored.docs[k : k + 1024] == NO_ID)
                    yield pa.RecordBatch.from_arrays([names, pa.array(starts + at), pa.array(stored.counts[k : k + 1024]), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(partitions(files.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
