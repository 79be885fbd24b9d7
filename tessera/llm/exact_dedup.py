"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

The texts are read once, to a narrow table of ids and digests; from then on no text moves. Pass one sends
each digest to a word of a blocked Bloom filter (two bits in one of 64) and keeps the words in which bits
were set again by an equal pair; pass two lets rows whose bits were not straight through, as no row
shares their text, and only the possibly repeated ones are grouped by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cleared, staged, with_group

#: Bits of the filter for each row, two of which it sets.
BITS_PER_ROW = 16


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _masked(rows: DataFrame, words: int) -> DataFrame:
    """rows with the word of the filter that their digest falls in, and the two bits that it sets there."""
    one, two = (F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest, {k}), 64) as int))") for k in (1, 2))
    return rows.withColumns({"word": F.pmod(F.xxhash64("digest"), F.lit(words)), "mask": one.bitwiseOR(two)})


def _filter(rows: DataFrame, words: int) -> DataFrame:
    """Pass one: (word, bits) of the bits that equal pairs set more than once."""
    again = _masked(rows, words).groupBy("word", "mask").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return again.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of exact_dedup, and the staged tables that they are read from."""
    rows = staged(docs.select(docs[id_col].cast("long").alias("doc_id"), _digest(docs[text_col]).alias("digest")), "digests")
    words = max(1 << 10, -(-rows.count() * BITS_PER_ROW // 64))
    # written, so that its size is known: Spark broadcasts it below its threshold and else joins ids and digests by word
    again = staged(_filter(rows, words), "filter")
    judged = _masked(rows, words).join(again, "word", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))

    # pass two
    hex_digest = F.lower(F.hex("digest")).alias("text_sha256")
    alone = judged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_digest)
    maybe = judged.filter("maybe").select("doc_id", "digest")
    groups = staged(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    grouped = with_group(maybe, groups, ["digest"], "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hex_digest)
    return alone.unionByName(grouped), [rows, again, groups]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the largest doc_id stays.
    Null text: counts as empty. Empty table: no rows. Repeated rows (same id and text): each counts in
    group_size and each is kept or dropped as its id is. Null ids: never chosen over a real id.
    """
    return _judged(docs, id_col, text_col)[0]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept.

    The ids that go are a written table: below Spark's threshold they are broadcast and no text moves;
    beyond it, texts are shuffled once, by id. Only where rows of one id differ in text, so that some
    stay and others go, digests are looked up as well.
    """
    judged, tables = _judged(docs, id_col, text_col)
    ids = staged(judged.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).filter(~F.col("all")), "ids")
    gone = staged(ids.filter(~F.col("some")).select("doc_id").sort("doc_id"), "gone")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    mixed = ids.filter("some").select(F.col("doc_id").alias("id"))
    if not mixed.isEmpty():
        off = staged(judged.filter(~F.col("kept")).join(mixed, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("doc_id", F.unhex("text_sha256").alias("digest")).distinct(), "mixed")
        rows = rows.withColumn("digest", _digest(F.col("text")))
        rows = rows.join(off, rows["doc_id"].eqNullSafe(off["doc_id"]) & (rows["digest"] == off["digest"]), "left_anti")
    cleared(*tables, ids)
    return rows.select("row.*")
