"""Links to providers' pages, made anew from what identities say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: what an id that is no number may be made of.
SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,120}$"


def page_url(provider: Column, id: Column, pages: dict[str, str], slugs: Sequence[str]) -> Column:
    """The page of an id: pages are patterns with %s. Ids must be numbers, or plain slugs for some providers; null otherwise."""
    low = F.lower(provider)
    page = F.create_map(*(F.lit(x) for pair in pages.items() for x in pair))[low]
    ok = F.when(low.isin(*slugs), id.rlike(SLUG)).otherwise(id.rlike(r"^\d+$"))
    return F.when(ok, F.replace(page, F.lit("%s"), id))


def rebuilt(games: DataFrame, ids: DataFrame, blocked: DataFrame, pages: dict[str, str], keyed: Sequence[str], slugs: Sequence[str] = ()) -> DataFrame:
    """(game_id, provider, provider_id, url): the links that ids give games, and no others.

    games: game_id, norm_key, platform; ids: provider, norm_key, provider_id, platform. A provider of `keyed` has
    an id for each platform, which links the game of that platform only; others link all games of the key.
    A miss (0, negative or null) links nothing, nor does anything link a blocked game. One link a game and provider.
    """
    of = F.col("provider_id")
    low = F.lower(F.trim(F.coalesce("platform", F.lit(""))))
    real = ids.filter(F.lower("provider").isin(*pages) & of.isNotNull() & ~of.cast("string").isin("", "0") & ~F.startswith(of.cast("string"), F.lit("-")))
    real = real.select("provider", "norm_key", of.cast("string").alias("provider_id"), low.alias("_on"), F.col("provider").isin(*keyed).alias("_keyed")).filter("not _keyed or _on <> ''")
    mine = games.join(blocked.select("game_id").distinct(), "game_id", "left_anti").select("game_id", "norm_key", low.alias("_at"))
    # the platform is part of the key where it counts, so that a name's games and ids never meet all with all
    by_key = mine.join(real.filter("not _keyed").drop("_on"), "norm_key")
    by_platform = mine.join(real.filter("_keyed").withColumnRenamed("_on", "_at"), ["norm_key", "_at"])
    rows = by_key.select("game_id", "provider", "provider_id").unionByName(by_platform.select("game_id", "provider", "provider_id"))
    one = rows.groupBy("game_id", "provider").agg(F.min("provider_id").alias("provider_id"))
    return one.withColumn("url", page_url(F.col("provider"), F.col("provider_id"), pages, slugs))


def replaced(links: DataFrame, new: DataFrame, games: DataFrame, providers: Sequence[str], scope: DataFrame | None = None) -> DataFrame:
    """links with those of some providers made anew, for the games whose norm_key is in scope (all without one): an identity that is gone leaves no link."""
    inside = games if scope is None else games.join(scope.select("norm_key").distinct(), "norm_key", "left_semi")
    ids = inside.select("game_id").distinct()
    old = links.join(ids.withColumn("_in", F.lit(True)), "game_id", "left").filter(F.col("_in").isNull() | ~F.col("provider").isin(*providers)).drop("_in")
    return old.unionByName(new.join(ids, "game_id", "left_semi"))
