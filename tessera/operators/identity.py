"""The handle index: keys (ns, val) that name identities, looked up in layers, matched through a gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.eras import generation, impossible, last_year
from tessera.functions.platforms import canon


def siblings(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Every key of the identity that an asked (ns, val) names."""
    found = asked.join(keys, ["ns", "val"]).select(F.col("ns").alias("asked_ns"), F.col("val").alias("asked_val"), "identity_id")
    return found.join(keys, "identity_id").select("asked_ns", "asked_val", "identity_id", "ns", "val")


def layered(asked: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """asked (ns, val) with identity_id and layer of the first layer that knows the key.

    A layer's null identity is a statement (the key is unbound) and hides the layers below it.
    """
    out = asked
    answer, source = None, None
    for name, layer in layers:
        out = out.join(layer.select("ns", "val", F.col("identity_id").alias(f"_{name}"), F.lit(True).alias(f"_{name}_has")), ["ns", "val"], "left")
    for name, _ in reversed(layers):
        has = F.col(f"_{name}_has").isNotNull()
        answer = F.when(has, F.col(f"_{name}")) if answer is None else F.when(has, F.col(f"_{name}")).otherwise(answer)
        source = F.when(has, name) if source is None else F.when(has, name).otherwise(source)
    return out.select("ns", "val", answer.alias("identity_id"), source.alias("layer"))


def gated(owned: DataFrame, candidates: DataFrame, block: str, gate: Column, id_owned: str, id_candidate: str) -> DataFrame:
    """The best accepted candidate of each owned row, among those of one block key; gate: struct(ok, score)."""
    pairs = owned.join(candidates, block).withColumn("_gate", gate).filter("_gate.ok")
    best = pairs.groupBy(id_owned).agg(F.max(F.struct(F.col("_gate.score"), -F.col(id_candidate))).alias("_best"))
    return best.select(id_owned, (-F.col("_best.col2")).alias(id_candidate), F.col("_best.score").alias("score"))


def gated_kinds(owned: DataFrame, candidates: DataFrame, block: str, title: str, features: Callable[[Column], Column], gate: Callable[[Column, Column], Column], id_owned: str, id_candidate: str) -> DataFrame:
    """As gated(), for titles whose rows are alike in block and title: of such candidates only the smallest id can win, and such owned rows have one answer.

    owned: id_owned, block, title; candidates: id_candidate, block, title; gate: struct(ok, score) of an owned title's features and a
    candidate's. Features are made once for a title and block, and only different titles are judged, so copies of rows add to the work by their number and not by its square. A null block has no match.
    """
    asked = owned.select(block, F.col(title).alias("_t")).distinct().withColumn("_f", features(F.col("_t")))
    firsts = candidates.groupBy(block, F.col(title).alias("_u")).agg(F.min(id_candidate).alias("_first")).select(block, "_first", features(F.col("_u")).alias("_g"))
    judged = asked.join(firsts, block).select(block, "_t", "_first", gate(F.col("_f"), F.col("_g")).alias("_gate"))
    best = judged.groupBy(block, "_t").agg(F.max(F.when(F.col("_gate.ok"), F.struct(F.col("_gate.score"), -F.col("_first")))).alias("_best")).filter("_best is not null")
    rows = owned.join(best.withColumnRenamed("_t", title), [block, title])
    return rows.select(id_owned, (-F.col("_best.col2")).alias(id_candidate), F.col("_best.score").alias("score"))


def unique_or_conflict(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with one distinct value keep it; those with more are in conflict and have none."""
    both = rows.groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("n"))
    return both.select(*keys, F.when(F.col("n") == 1, F.col(value)).alias(value), F.when(F.col("n") == 1, "resolved").otherwise("conflict").alias("status"))


def refuse_shared(bindings: DataFrame, value: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): a value that several keys claim is nobody's; refusals are returned, not lost."""
    claims = bindings.groupBy(value).agg(F.countDistinct(key).alias("_claims"))
    marked = bindings.join(claims, value)
    return marked.filter("_claims = 1").drop("_claims"), marked.filter("_claims > 1").withColumnRenamed("_claims", "claims")


def guard_collisions(wanted: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """A value goes to the first key that asks for it; later ones record a miss by collision."""
    first = F.row_number().over(Window.partitionBy(value).orderBy(order)) == 1
    return wanted.select(key, F.when(first, F.col(value)).alias(value), F.when(first, "found").otherwise("collision").alias("status"))


def mint(rows: DataFrame, known: DataFrame, key: str, base: int) -> DataFrame:
    """Rows that a known key covers take its identity; others get base + their own id."""
    return rows.join(known, key, "left").select("id", key, F.coalesce("identity_id", F.col("id") + F.lit(base)).alias("identity_id"), F.col("identity_id").isNull().alias("minted"))


def fits_of_entry(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """asked (id, entry, platform) with fits, one and gen: how many candidates of the entry are on the platform, the smallest of them, the entry's smallest gen.

    candidates: cand, entry, platform, gen. They are counted before the join, so a row is asked once and meets no list. Entries without any: no row.
    """
    rows = candidates.distinct()
    on = rows.groupBy("entry", "platform").agg(F.count(F.lit(1)).alias("fits"), F.min("cand").alias("one"))
    known = rows.groupBy("entry").agg(F.min("gen").alias("gen"))
    return asked.join(known, "entry").join(on, ["entry", "platform"], "left").select("id", F.coalesce("fits", F.lit(0)).alias("fits"), "one", "gen")


# Sources that are no stores, and types of what holds several games.
NO_STORES, BUNDLES = ("emulation", "archive"), (3, 13)


def refused_identities(bindings: DataFrame, sources: DataFrame, types: DataFrame) -> DataFrame:
    """(norm_key, identity_id, why) of bindings (norm_key, identity_id) that can't be one game's.

    compilation: the identity (types: identity_id, type) is of a kind that holds several games. many_to_one: one store
    (sources: norm_key, source, source_id) sold several things of several titles under it; dumps and archives don't
    count, and no more do copies in different stores. Two of a kind are found by the smallest and the largest.
    """
    typed = bindings.join(types.select("identity_id", "type"), "identity_id", "left").withColumn("_bundle", F.coalesce(F.col("type").isin(*BUNDLES), F.lit(False)))
    rows = typed.filter("not _bundle").join(sources.filter(~F.col("source").isin(*NO_STORES) & (F.coalesce("source_id", F.lit("")) != "")), "norm_key")
    sold = rows.groupBy("identity_id", "source").agg(*(f(c).alias(f"_{n}_{c}") for c in ("norm_key", "source_id") for n, f in (("min", F.min), ("max", F.max))))
    several = sold.filter("_min_norm_key <> _max_norm_key and _min_source_id <> _max_source_id").select("identity_id", "source")
    many = rows.join(several, ["identity_id", "source"], "left_semi").select("norm_key", "identity_id").distinct()
    bundles = typed.filter("_bundle").select("norm_key", "identity_id").distinct()
    return bundles.withColumn("why", F.lit("compilation")).unionByName(many.withColumn("why", F.lit("many_to_one")))


def era_picks(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, id) for each key asked: the candidate of its title that fits in time and hardware, null where none can be told.

    asked: key, consoles (labels), platform, year (stated, or null), unique (whether two left are one too many);
    hits: key, rank, id, year, platforms, the candidates of equal titles. A candidate that is too new for every console is
    out; a console's entry takes those that name it, and none if all name others only; a stated year that one alone has
    decides. What is left is taken by year, the earliest first, on consoles whose era is known, else by rank.
    All of it follows from counts and smallest values, so one grouping does and no list of candidates is made.
    """
    consoles = F.coalesce("consoles", F.array().cast("array<string>"))
    rows = asked.withColumnRenamed("year", "_want").join(hits.select("key", "rank", "id", "year", "platforms"), "key", "left")
    fine = F.col("id").isNotNull() & (F.col("year").isNull() | (F.size(consoles) == 0) | ~F.forall(consoles, lambda c: impossible(c, F.col("year"))))
    theirs = F.transform(F.filter(F.coalesce("platforms", F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), lambda p: canon(p))
    stated, fits = fine & (F.size(theirs) > 0), fine & F.array_contains(theirs, canon(F.col("platform")))
    bound = F.exists(consoles, lambda c: last_year(c).isNotNull())
    order = F.struct(F.when(bound & F.col("year").isNull(), 1).otherwise(0).alias("undated"), F.when(bound, F.col("year")).alias("year"), "rank", "id")
    same = F.col("year") == F.col("_want")
    rows = rows.select("key", "unique", generation(canon(F.col("platform"))).isNotNull().alias("console"), fine.alias("fine"), stated.alias("stated"), F.coalesce(fits, F.lit(False)).alias("fits"), F.coalesce(same, F.lit(False)).alias("same"), order.alias("order"))
    sets = {"o": F.col("fine"), "f": F.col("fits")}
    counts = [x for n, on in sets.items() for x in (F.count_if(on).alias(f"n_{n}"), F.count_if(on & F.col("same")).alias(f"y_{n}"), F.min(F.when(on & F.col("same"), F.col("order"))).alias(f"s_{n}"), F.min(F.when(on, F.col("order"))).alias(f"b_{n}"))]
    found = rows.groupBy("key", "unique", "console").agg(F.count_if("stated").alias("n_stated"), *counts)
    only = F.col("console") & (F.col("n_f") > 0)
    of = lambda c: F.when(only, F.col(f"{c}_f")).otherwise(F.col(f"{c}_o"))
    elsewhere = F.col("console") & (F.col("n_f") == 0) & (F.col("n_stated") > 0) & (F.col("n_stated") == F.col("n_o"))
    by_year = (of("n") > 1) & (of("y") == 1)
    chosen = F.when(elsewhere, None).when(by_year, of("s")["id"]).when(F.col("unique") & (of("n") > 1), None).otherwise(of("b")["id"])
    return found.select("key", chosen.alias("id"))
