"""What publishing to a target would do: copies, conversions, updates, removals, what is blocked and whether it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COPY, CONVERT, UPDATE, REMOVE, SKIP, BLOCKED = "copy", "convert", "update", "remove", "skip", "blocked"


def items(want: DataFrame, entries: DataFrame, files: DataFrame, ledger: DataFrame, absent: DataFrame, formats: DataFrame, tools: DataFrame) -> DataFrame:
    """(key, disc, action, reason, tool, target_ext, bytes, blocker): one row for each disc that is wanted, and for each published key that is not.

    want, absent, tools: key, key, tool; entries: key, system; files: key, disc, ext, sig, bytes; ledger: key, sig;
    formats: system, ext, target_ext, tool, what a system's files are converted to and by what. A file without
    a format is copied as it is. A key that the catalog lacks, without files, or whose tool is missing is blocked.
    """
    rows = want.select("key").distinct().join(entries.select("key", "system", F.lit(True).alias("_entry")), "key", "left").join(files, "key", "left")
    rows = rows.join(formats.select("system", "ext", "target_ext", "tool"), ["system", "ext"], "left")
    rows = rows.join(tools.select("tool", F.lit(True).alias("_here")).distinct(), "tool", "left").join(ledger.select("key", F.col("sig").alias("_done"), F.lit(True).alias("_led")), "key", "left")
    rows = rows.join(absent.select("key", F.lit(True).alias("_gone")).distinct(), "key", "left")
    tool = F.coalesce("tool", F.lit(COPY))
    blocker = (
        F.when(F.col("_entry").isNull(), "unknown entry").when(F.col("disc").isNull(), "no source file").when((tool != COPY) & F.col("_here").isNull(), F.concat(tool, F.lit(" not available")))
    )
    put = F.when(tool != COPY, CONVERT).otherwise(COPY)
    same = F.col("sig").eqNullSafe(F.col("_done"))
    action = F.when(blocker.isNotNull(), BLOCKED).when(F.col("_led").isNull() | F.col("_gone").isNotNull(), put).when(~same, UPDATE).otherwise(SKIP)
    reason = (
        F.when(F.col("_entry").isNull(), "entry is not in the catalog").when(F.col("disc").isNull(), "no file of it is known").when(F.col("_led").isNull(), "not present on the target").when(F.col("_gone").isNotNull(), "published, but not on the target now")
        .when(~same, "source changed since it was published").otherwise("unchanged")
    )
    wanted = rows.select("key", "disc", action.alias("action"), reason.alias("reason"), F.when(F.col("disc").isNotNull(), F.nullif(tool, F.lit(COPY))).alias("tool"), "target_ext", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), blocker.alias("blocker"))
    over = ledger.select("key").distinct().join(want.select("key"), "key", "left_anti").join(absent.select("key", F.lit(True).alias("_gone")).distinct(), "key", "left")
    gone = F.col("_gone").isNotNull()
    none = F.lit(None).cast("string")
    removed = over.select(
        "key", F.lit(None).cast(files.schema["disc"].dataType).alias("disc"), F.when(gone, SKIP).otherwise(REMOVE).alias("action"), F.when(gone, "not wanted any more, and already gone").otherwise("not wanted any more").alias("reason"),
        none.alias("tool"), none.alias("target_ext"), F.lit(0).cast("long").alias("bytes"), none.alias("blocker"),
    )
    return wanted.unionByName(removed)


def capacity(planned: DataFrame, free: DataFrame, target: str) -> DataFrame:
    """(target, need, free, over): whether what each target's plan writes fits in what it has free; what is unknown refuses nothing."""
    write = F.col("action").isin(COPY, CONVERT, UPDATE)
    need = planned.groupBy(target).agg(F.sum(F.when(write, F.col("bytes")).otherwise(0)).alias("need"))
    return need.join(free.select(target, "free"), target, "left").withColumn("over", F.coalesce(F.col("need") > F.col("free"), F.lit(False)))


def unmanaged(observed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Observed paths (target, path) that the ledger (target, path, extra paths) doesn't have: the user's, and never to be removed."""
    ours = ledger.select("target", F.explode(F.concat(F.array("path"), F.coalesce("extra", F.array().cast("array<string>")))).alias("path"))
    return observed.join(ours, ["target", "path"], "left_anti")
