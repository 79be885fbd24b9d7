"""Folding source rows into catalog entries, and what entries gather: summaries, attributes, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold_sources(rows: DataFrame, store_sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sources, entries) of rows (norm_key, platform, source, source_id, title, detail, state, seq).

    Within an entry (norm_key, platform) rows of one (source, source_id) are one: have beats want, details
    are united, the first title by seq stays. An entry is named by its first owned store row, else its first row.
    """
    one = rows.groupBy("norm_key", "platform", "source", "source_id").agg(
        F.when(F.max((F.col("state") == "have").cast("int")) == 1, "have").otherwise("want").alias("state"),
        F.array_join(F.sort_array(F.collect_set(F.nullif("detail", F.lit("")))), ",").alias("detail"),
        F.min(F.struct("seq", "title")).alias("first"),
        F.min(F.when(F.col("source").isin(store_sources) & (F.col("state") == "have"), F.struct("seq", "title"))).alias("store"),
    )
    sources = one.select("norm_key", "platform", "source", "source_id", F.col("first.title").alias("title"), "detail", "state")
    entries = one.groupBy("norm_key", "platform").agg(
        F.coalesce(F.min("store")["title"], F.min("first")["title"]).alias("title"),
        F.count(F.lit(1)).alias("n_sources"),
        F.size(F.collect_set("source")).cast("long").alias("n_kinds"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources_summary"),
        F.max((F.col("state") == "have").cast("int")).alias("owned"),
    )
    return sources, entries


def first_wins(rows: DataFrame, keys: list[str], kind: str, value: str, provider: str, order: Column) -> DataFrame:
    """Scalar attributes of several providers: the first provider's value stays, with all providers that agree."""
    first = rows.groupBy(*keys, kind).agg(F.min_by(F.col(value), F.struct(order, F.col(value))).alias("_first"))
    agreed = rows.join(first, [*keys, kind]).filter(F.col(value) == F.col("_first"))
    return agreed.groupBy(*keys, kind, value).agg(F.array_join(F.sort_array(F.collect_set(provider)), ",").alias("origins"))


def united(rows: DataFrame, keys: list[str], kind: str, value: str, provider: str) -> DataFrame:
    """List attributes: every value, with its providers."""
    return rows.groupBy(*keys, kind, value).agg(F.array_join(F.sort_array(F.collect_set(provider)), ",").alias("origins"))


def fill_gaps(own: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """own, and of what is offered the rows whose keys own lacks."""
    return own.unionByName(offered.join(own.select(*keys).distinct(), keys, "left_anti"))


def year_labels(entries: DataFrame, title: str, year: str) -> DataFrame:
    """Titles that occur with two years or more get theirs in brackets; running it again changes nothing."""
    base = F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", ""))
    rows = entries.withColumns({"_base": base, "_fold": F.lower(base)})
    years = rows.groupBy("_fold").agg(F.countDistinct(year).alias("_years"), F.count(F.lit(1)).alias("_n"))
    label = F.when((F.col("_n") > 1) & (F.col("_years") > 1) & F.col(year).isNotNull(), F.concat("_base", F.lit(" ("), F.col(year).cast("string"), F.lit(")"))).otherwise(F.col(title))
    return rows.join(years, "_fold").withColumn(title, label).drop("_base", "_fold", "_years", "_n")


def separate(entries: DataFrame, handhelds: list[str], retro: list[str]) -> DataFrame:
    """Base keys of entries (norm_key, platform, is_store, impossible): ones that can't be their title's game stand apart.

    impossible: the title's year is beyond the platform's era. An entry is split off when it is impossible
    and another platform isn't, or when it is on a retro handheld and another platform is a home one.
    Store entries stay. Counts over the key's entries, less the entry's own, replace a loop over them.
    """
    key = Window.partitionBy("norm_key")
    home = F.col("is_store") | ~F.col("platform").isin(handhelds)
    fits = F.col("is_store") | (F.col("impossible") == F.lit(False))
    number = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    others = lambda c: F.sum(number(c)).over(key) - number(c)
    era = F.coalesce(F.col("impossible"), F.lit(False)) & (others(fits) > 0)
    stray = F.col("platform").isin(retro) & (others(home) > 0)
    mark = F.when(F.col("is_store"), None).when(era, "\x1f").when(stray, "\x1e")
    return entries.withColumn("base_key", F.when(mark.isNull(), F.col("norm_key")).otherwise(F.concat("norm_key", mark, "platform")))


def merge_regional(sources: DataFrame, canonical: DataFrame) -> DataFrame:
    """Source rows (game_key, platform, norm_key, source, source_id, title) under one norm_key for each game and platform.

    The entry whose key is the game's own (canonical: game_key, canon_key) represents it, else the one with
    most sources, else the smallest key. Equal (source, source_id, title) become one row.
    """
    counts = sources.groupBy("game_key", "platform", "norm_key").agg(F.count(F.lit(1)).alias("n")).join(canonical, "game_key", "left")
    rank = F.struct(F.when(F.col("norm_key").eqNullSafe(F.col("canon_key")), 0).otherwise(1), -F.col("n"), F.col("norm_key"))
    rep = counts.groupBy("game_key", "platform").agg(F.min_by("norm_key", rank).alias("rep"))
    moved = sources.join(rep, ["game_key", "platform"])
    return moved.select("game_key", "platform", F.col("rep").alias("norm_key"), "source", "source_id", "title").distinct()
