"""Packing by concatenating and cutting.

Encoded rows are written once with their place in their task's row of ids. Prefix sums over the tasks'
totals (one row a task) turn those into places in the corpus's row of ids, and cutting that row at every
multiple of the window gives the sequences: only the last one is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .tokens import encode, forget, slices, wide

WINDOW = 1024


def task_offsets(encoded: DataFrame, n: str = "n") -> DataFrame:
    """(part, offset): the ids of all tasks before each; a row for each task that encoded, and no more."""
    totals = encoded.groupBy("part").agg(F.sum(n).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("offset"))


def cut(encoded: DataFrame, window: int = WINDOW) -> DataFrame:
    """Boundary records of encoded rows: a row for each piece, with the piece's ids (32-bit little-endian bytes)."""
    placed = encoded.join(F.broadcast(task_offsets(encoded)), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("at"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the ids are written: no task of this stage encodes
        for batch in slices(batches):
            docs, starts, sizes, totals, sequences, offsets, ids = [], [], [], [], [], [], []
            for doc, at, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = wide(stored)
                n = len(own) // 4
                edges = [0, *range(window - at % window, n, window), n]
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a:
                        docs.append(doc), starts.append(a), sizes.append(b - a), totals.append(n), ids.append(own[4 * a : 4 * b])
                        sequences.append((at + a) // window), offsets.append((at + a) % window)
            numbers = [pa.array(np.array(x, "i8")) for x in (starts, sizes, totals, sequences, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *numbers, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every row in exactly one piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Null or empty text: its end id alone. Empty table: no pieces. Repeated rows and ids: each row is
    packed by itself. A text longer than a window is cut into as many pieces as it touches windows.
    """
    return cut(staged(encode(docs, tokenizer_path, end_id, id_col, text_col), "encoded"), window)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids): the packed sequences put together, unpadded."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", "n", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
