"""Decisions of users, providers and models over a catalog: who is asked, who wins, what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def prevailing(auto: DataFrame, user: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The user's value where there is one, else the automatic one, with its origin."""
    both = auto.select(*keys, F.col(value).alias("_a")).join(user.select(*keys, F.col(value).alias("_u"), F.lit(True).alias("_has")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_has"), F.col("_u")).otherwise(F.col("_a")).alias(value), F.when(F.col("_has"), "user").otherwise("auto").alias("origin"))


def rekeyed(rows: DataFrame, aliases: DataFrame, key: str, rest: list[str], order: Column) -> DataFrame:
    """Rows under the keys that aliases (alias, target) lead to; of rows that meet there, the target's own wins."""
    moved = rows.join(aliases.select(F.col("alias").alias(key), "target"), key, "left").withColumns({"_own": F.col("target").isNull(), "_key": F.coalesce("target", key)})
    first = F.row_number().over(Window.partitionBy("_key", *rest).orderBy(F.col("_own").desc(), order))
    return moved.withColumn("_place", first).filter("_place = 1").drop(key, "target", "_own", "_place").withColumnRenamed("_key", key)


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Empty values filled where all others of the key agree."""
    agreed = rows.groupBy(key).agg(F.min(value).alias("_one"), F.countDistinct(value).alias("_n"))
    return rows.join(agreed, key).withColumn(value, F.coalesce(F.col(value), F.when(F.col("_n") == 1, F.col("_one")))).drop("_one", "_n")


def release_of(rows: DataFrame, keys: list[str], kind: str, order: Column) -> DataFrame:
    """Null (commercial) as soon as one dump is, else the first kind."""
    return rows.groupBy(*keys).agg(F.when(~F.max(F.col(kind).isNull()), F.min_by(kind, order)).alias(kind))


def allowed(platform: Column, sources: Column, off_platforms: list[str], off_sources: list[str]) -> Column:
    """Whether a provider is asked: not for a platform that is off, nor when all sources of a game are."""
    off = F.array(*map(F.lit, off_sources)).cast("array<string>")
    return ~F.coalesce(platform.isin(off_platforms) if off_platforms else F.lit(False), F.lit(False)) & ~((F.size(sources) > 0) & (F.size(F.array_except(sources, off)) == 0))


def language_filter(assets: DataFrame, language: str, wanted: list[str], mode: str) -> DataFrame:
    """Assets with `hidden`, or without those that are banned. Unknown languages stay, and no wish is no wish for nothing."""
    if mode not in ("off", "hide", "ban"):
        raise ValueError(f"unknown mode {mode!r}")
    off = F.lit(False) if mode == "off" or not wanted else F.col(language).isNotNull() & ~F.col(language).isin(wanted)
    return assets.filter(~off).withColumn("hidden", F.lit(False)) if mode == "ban" else assets.withColumn("hidden", off)


def covered(entries: DataFrame, assets: DataFrame, uploads: DataFrame) -> DataFrame:
    """entries (norm_key, platform, game_key) with has_cover: own console's art, neutral art of the same identity, or an upload."""
    own = assets.filter("system <> ''").select("norm_key", F.col("system").alias("platform"), F.lit(True).alias("_own")).distinct()
    neutral = assets.filter("system = ''").select("norm_key", "game_key", F.lit(True).alias("_neutral")).distinct()
    up = uploads.select("norm_key", F.lit(True).alias("_up")).distinct()
    rows = entries.join(own, ["norm_key", "platform"], "left").join(neutral, ["norm_key", "game_key"], "left").join(up, "norm_key", "left")
    return rows.select("norm_key", "platform", "game_key", F.coalesce("_own", "_neutral", "_up", F.lit(False)).alias("has_cover"))


def learned(pairs: DataFrame, known: DataFrame, base: int) -> DataFrame:
    """pairs (find, ns, val) with an identity for each find: the smallest that one of its keys has, else base + find."""
    hit = pairs.join(known, ["ns", "val"], "left").groupBy("find").agg(F.min("identity_id").alias("_hit"))
    return pairs.join(hit, "find").select("find", "ns", "val", F.coalesce("_hit", F.col("find") + F.lit(base)).alias("identity_id"), F.col("_hit").isNull().alias("minted"))


def decided(kind: Column, own_id: Column, primary: Column, confidence: Column, same: Column, detach: Column, other: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """(action, id) for an entry: a unique fit is set; else a sure verdict may detach or set, and doubt keeps the group's id."""
    sure = (F.coalesce(confidence, F.lit(0.0)) >= threshold) & ~F.coalesce(same, F.lit(False))
    out = F.coalesce(detach, F.lit(False))
    action = F.when(kind == "unique", "set").when(sure & out, "detach").when(sure & other.isNotNull(), "set").otherwise("keep")
    return action, F.when(kind == "unique", own_id).when(action == "detach", None).when(action == "set", other).otherwise(primary)


def resolved(asked: DataFrame, cached: DataFrame, index: DataFrame, now: int, ttl: int) -> DataFrame:
    """(key, id, how): the cached decision, a fresh miss, the index's answer, else to be searched for.

    cached: key, id (null: a miss), at; a miss older than ttl counts no more.
    """
    rows = asked.join(cached.select("key", F.col("id").alias("_c"), "at"), "key", "left").join(index.select("key", F.col("id").alias("_i")), "key", "left")
    fresh = F.col("_c").isNull() & F.col("at").isNotNull() & (F.col("at") >= now - ttl)
    how = F.when(F.col("_c").isNotNull(), "cached").when(fresh, "miss").when(F.col("_i").isNotNull(), "index").otherwise("search")
    return rows.select("key", F.when(how == "cached", F.col("_c")).when(how == "index", F.col("_i")).alias("id"), how.alias("how"))


def series_members(series: DataFrame, titles: DataFrame, crossover: int = 4) -> DataFrame:
    """(id, series): a game in so many series is a crossover and stays only in those that its title names."""
    counts = series.groupBy("id").agg(F.countDistinct("series").alias("_n"))
    rows = series.join(counts, "id").join(titles, "id")
    lead = F.split_part(F.lower("series"), F.lit(" "), F.lit(1))
    named = F.contains(F.lower("title"), F.lower("series")) | ((F.length(lead) >= 5) & F.startswith(F.lower("title"), lead))
    return rows.filter((F.col("_n") < crossover) | named).select("id", "series").distinct()


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows of every key that comes anew taken out and the new ones put in."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def unofficial(entries: DataFrame, kinds: list[str]) -> DataFrame:
    """entries (norm_key, platform, kind, is_store) with `blocked`: an unofficial kind with no store entry of its title."""
    store = F.max(F.col("is_store")).over(Window.partitionBy("norm_key"))
    return entries.withColumn("blocked", F.col("kind").isin(kinds) & ~store)


def target_flags(games: DataFrame, links: DataFrame, attributes: DataFrame, kinds: list[str], identity: str) -> DataFrame:
    """games (game_id) with unmatched (no provider's link), unidentified (none of the identity provider) and missing (an attribute kind of `kinds` is)."""
    of_links = links.groupBy("game_id").agg(F.max(F.col("provider") == identity).alias("_identified"))
    has = attributes.filter(F.col("kind").isin(kinds)).groupBy("game_id").agg(F.size(F.collect_set("kind")).alias("_kinds"))
    rows = games.select("game_id").join(of_links, "game_id", "left").join(has, "game_id", "left")
    return rows.select("game_id", F.col("_identified").isNull().alias("unmatched"), (~F.coalesce("_identified", F.lit(False))).alias("unidentified"), (F.coalesce("_kinds", F.lit(0)) < len(kinds)).alias("missing"))
