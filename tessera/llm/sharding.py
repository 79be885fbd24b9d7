"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's key decides its shard without a ring table; when a shard is appended, it takes about one row in
`shards + 1`, and no other row moves. Places within a shard come from two-level prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_text, partitions

# The multiplier of the generator that jump consistent hashing steps by, in 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
FULL, HALF = 0xFFFFFFFF, 0xFFFF
#: Steps of the folds that come before the one for what still isn't done.
FOLDS = (12, 52)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _low_product(x: Column, by: int) -> Column:
    """x * by modulo 2^32 for an x below 2^32, without overflow."""
    upper = F.shiftleft((x * F.lit(by >> 16)).bitwiseAND(F.lit(HALF)), 16)
    return (x * F.lit(by & HALF) + upper).bitwiseAND(F.lit(FULL))


def jump_hash(key: Column, shards: int) -> Column:
    """The jump consistent hash of a long key, an int from 0 to shards - 1; a null key counts as 0.

    The generator multiplies modulo 2^64. SQL's multiplication doesn't wrap, so the state is held as
    32-bit halves and each product is made of 16-bit parts. Every step moves j on, so `shards` steps do, and most keys need few.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    key = F.coalesce(key, F.lit(0)).cast("long")

    def step(s: Column, _: Column) -> Column:
        h, l, j = s["h"], s["l"], s["j"]  # noqa: E741
        parts = F.struct((l * F.lit(LOW & HALF)).alias("a"), (l * F.lit(LOW >> 16)).alias("b"))
        summed = _let(parts, lambda t: F.struct(
            (t["a"].bitwiseAND(F.lit(FULL)) + F.shiftleft(t["b"].bitwiseAND(F.lit(HALF)), 16) + F.lit(1)).alias("low"),
            (F.shiftright(t["a"], 32) + F.shiftright(t["b"], 16)).alias("carry"),
        ))
        state = _let(summed, lambda t: F.struct(
            (_low_product(h, LOW) + _low_product(l, HIGH) + t["carry"] + F.shiftright(t["low"], 32)).bitwiseAND(F.lit(FULL)).alias("h"),
            t["low"].bitwiseAND(F.lit(FULL)).alias("l"),
        ))
        moved = _let(state, lambda t: F.struct(
            t["h"].alias("h"), t["l"].alias("l"), j.alias("b"),
            F.floor((j + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(t["h"], 1) + 1).cast("double"))).cast("long").alias("j"),
        ))
        return F.when(j >= F.lit(shards), s).otherwise(moved)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(F.lit(FULL)).alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )
    def walk(steps: int):
        left = lambda s: F.when(s["j"] >= F.lit(shards), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(steps)))
        return lambda s: F.aggregate(left(s), s, step)

    # some ln(shards) steps are enough for nearly all keys: those that are done take no part in the longer folds
    state, left = start, shards
    for steps in (*FOLDS, shards):
        if left > 0:
            state, left = _let(state, walk(min(steps, left))), left - steps
    return state["b"].cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of each row.

    Size is the text's UTF-8 bytes plus 8. Slots run from 0 in each shard, by a stable piece of the shard
    and then doc_id. Null text: no bytes, crc32 0. Null id: as id 0 for the shard, after other rows of
    its piece. Repeated rows: each has its own slot. Empty table: no rows.
    """
    rows = id_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    # a shard is numbered by pieces, so that a task sorts a piece and never a shard
    pieces = partitions(docs.sparkSession)
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_last()))
    placed = rows.withColumn("place", place).join(starts, ["shard", "piece"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
