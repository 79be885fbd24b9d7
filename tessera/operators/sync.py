"""Merging, upserting, sweeping and planning by differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def content_hash(columns: list[str]) -> Column:
    """A hash of a row's cells as text, nulls as empty."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def three_way(local: DataFrame, remote: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """(key, action) for keys (hash, ts on both sides; hash in the shadow): what to do to bring both sides together.

    One side moved: it wins. Both moved: an edit beats a delete, of two edits the later wins, local at a tie.
    """
    side = lambda d, n: d.select(key, F.col("hash").alias(f"{n}_hash"), *([F.col("ts").alias(f"{n}_ts")] if n != "s" else []))
    rows = side(local, "l").join(side(remote, "r"), key, "full_outer").join(side(shadow, "s"), key, "full_outer")
    lh, rh, sh = F.col("l_hash"), F.col("r_hash"), F.col("s_hash")
    l_moved, r_moved = ~lh.eqNullSafe(sh), ~rh.eqNullSafe(sh)
    local_wins = (
        F.when(l_moved & ~r_moved, True).when(r_moved & ~l_moved, False).when(lh.isNull(), False).when(rh.isNull(), True).otherwise(F.coalesce("l_ts", F.lit(0.0)) >= F.coalesce("r_ts", F.lit(0.0)))
    )
    action = (
        F.when(lh.eqNullSafe(rh), "same").when(local_wins & lh.isNull(), "delete_remote").when(local_wins, "write_remote").when(rh.isNull(), "delete_local").otherwise("write_local")
    )
    return rows.select(key, action.alias("action"), F.when(lh.eqNullSafe(rh) | local_wins, lh).otherwise(rh).alias("hash"))


def upsert(table: DataFrame, rows: DataFrame, key: str, refreshed: list[str], kept: list[str]) -> DataFrame:
    """table with rows written over it: refreshed columns take the new value, kept ones stay where there is one."""
    old = table.select(key, *(F.col(c).alias(f"_o_{c}") for c in refreshed + kept), F.lit(True).alias("_old"))
    new = rows.select(key, *(F.col(c).alias(f"_n_{c}") for c in refreshed + kept), F.lit(True).alias("_new"))
    both = old.join(new, key, "full_outer")
    fresh = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in refreshed]
    return both.select(key, *fresh, *(F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in kept))


def sweep(table: DataFrame, stamp: str, now: int, scope: Column) -> DataFrame:
    """table without the rows of the scope that this scan has not stamped."""
    return table.filter(~scope | (F.col(stamp) == now))


def inventory(known: DataFrame, seen: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, status): new, changed, same or gone, by comparing the facts of what is known and what is seen."""
    a, b = known.select(key, F.struct(*facts).alias("_a")), seen.select(key, F.struct(*facts).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def effective(rules: DataFrame, includes: DataFrame, excludes: DataFrame, key: str) -> DataFrame:
    """What the rules match, and what is included by hand, less what is excluded by hand."""
    return rules.select(key).union(includes.select(key)).distinct().join(excludes.select(key), key, "left_anti")


def plan(want: DataFrame, ledger: DataFrame, absent: DataFrame, key: str) -> DataFrame:
    """(key, action, reason, bytes): want has (key, sig, bytes), the ledger (key, done_sig), absent the keys not on the target."""
    rows = want.select(key, "sig", "bytes", F.lit(True).alias("_want")).join(ledger.select(key, "done_sig", F.lit(True).alias("_done")), key, "full_outer").join(absent.select(key, F.lit(True).alias("_gone")), key, "left")
    wanted, done, gone = F.col("_want").isNotNull(), F.col("_done").isNotNull(), F.col("_gone").isNotNull()
    action = F.when(wanted & (~done | gone), "copy").when(wanted & ~F.col("sig").eqNullSafe(F.col("done_sig")), "update").when(wanted, "skip").when(gone, "skip").otherwise("remove")
    reason = (
        F.when(wanted & ~done, "not on the target").when(wanted & gone, "published, but gone from the target").when(wanted & ~F.col("sig").eqNullSafe(F.col("done_sig")), "the source has changed")
        .when(wanted, "unchanged").when(gone, "not wanted, and already gone").otherwise("not wanted any more")
    )
    return rows.select(key, action.alias("action"), reason.alias("reason"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
