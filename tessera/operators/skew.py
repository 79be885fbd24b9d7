"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that a task takes.
KEY_ROWS = 100_000


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, each: int = KEY_ROWS) -> DataFrame:
    """rows joined with groups (one row a key, `count` its rows): a key's rows are dealt to count / each tasks.

    Keys of more than `each` rows are at most rows / each; Spark broadcasts that list, or not, by its own threshold.
    """
    parts = F.ceil(F.col(count) / each).cast("int")
    hot = groups.filter(F.col(count) > each).select(*keys, parts.alias("__parts"))
    dealt = rows.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copies = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "__part"]).drop("__part")
