"""What was learned and decided, taken from one installation to another as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT = "learned-1"
#: Tables, and the columns that make a row of each one of a kind.
TABLES = {"identities": ["id"], "keys": ["ns", "val"], "overrides": ["ns", "val"]}


def exported(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the three tables as JSON lines below a folder, and last of all their format, without which nothing is taken in."""
    for name in TABLES:
        tables[name].write.json(f"{path}/{name}")
    tables["keys"].sparkSession.createDataFrame([(FORMAT,)], "format string").coalesce(1).write.json(f"{path}/format")


def imported(spark: SparkSession, path: str, there: dict[str, DataFrame], replace: bool = False) -> dict[str, DataFrame]:
    """The three tables with an export taken in. Keys and identities that are there stay as they are; of overrides, a person's word, those that come in win.

    replace: only what comes in. An export of another format, or a half-written one, is refused.
    """
    found = spark.read.json(f"{path}/format", schema="format string").first()
    if not found or found.format != FORMAT:
        raise ValueError(f"no export of the format {FORMAT}")
    out = {}
    for name, key in TABLES.items():
        new = spark.read.json(f"{path}/{name}", schema=there[name].schema).dropDuplicates(key)
        first, second = (new, there[name]) if name == "overrides" else (there[name], new)
        out[name] = new if replace else first.unionByName(second.join(first.select(*key), key, "left_anti").select(*first.columns))
    return out
