"""Electing one asset for each slot, with evidence from the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.assets import resolution_band, shape_ok

BUCKET = ("norm_key", "system", "kind")


def templates(media: DataFrame, least: int = 3) -> DataFrame:
    """Frames that so many titles share. The count is over all assets, whatever part of them is elected later."""
    return media.filter("frame is not null").groupBy("frame").agg(F.countDistinct("norm_key").alias("titles")).filter(F.col("titles") >= least)


def ranked(media: DataFrame, provider_rank: Column, shared: DataFrame, bucket: tuple[str, ...] = BUCKET) -> DataFrame:
    """Assets of a fitting shape, with place 1 for the elected one of each bucket.

    The order: pinned, authored before filler, no template, region, detail where all are filler, size band,
    provider, pixels, matched, id. Detail counts only in a bucket of several assets that all are filler.
    """
    w = Window.partitionBy(*bucket)
    rows = media.filter(shape_ok(F.col("kind"), F.col("width"), F.col("height"))).join(shared.select("frame", F.lit(1).alias("_shared")), "frame", "left")
    blind = (F.count(F.lit(1)).over(w) > 1) & (F.min(F.coalesce("filler", F.lit(0))).over(w) == 1)
    rows = rows.withColumn("_blind", blind)
    order = [
        F.coalesce("pin", F.lit(1 << 30)), F.coalesce("filler", F.lit(0)), F.coalesce("_shared", F.lit(0)), F.col("region_rank"),
        F.when(F.col("_blind"), -F.coalesce("detail", F.lit(0))).otherwise(F.lit(0)), resolution_band(F.col("kind"), F.col("width"), F.col("height")),
        provider_rank, -F.coalesce(F.col("width") * F.col("height"), F.lit(0)), F.when(F.col("matched"), 0).otherwise(1), F.col("id"),
    ]
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).drop("_shared", "_blind")


def elected(media: DataFrame, provider_rank: Column, shared: DataFrame, bucket: tuple[str, ...] = BUCKET) -> DataFrame:
    return ranked(media, provider_rank, shared, bucket).filter("place = 1").drop("place")


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Slots whose elected asset differs: added, removed or moved."""
    both = before.select(*keys, F.col(value).alias("was")).join(after.select(*keys, F.col(value).alias("now")), keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("moved")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("change", kind)
