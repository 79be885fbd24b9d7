"""Building the handle index: keys (ns, val) filed by steps in order, catalogues merged through the gate, finds learned.

A key belongs to the first step that files it, and a step's kind stays with it: `exact` where a source
states the pairing, `derived` where it was concluded from a name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .graphs import components

EXACT, DERIVED = "exact", "derived"


@dataclass
class Step:
    """keys: (ns, val, identity_id), and `kind` where rows of a step differ in it."""

    name: str
    keys: DataFrame
    kind: str = EXACT


def build(steps: Sequence[Step]) -> DataFrame:
    """(ns, val, identity_id, step, kind): each key and identity as the earliest step filed it. A name may lead to several identities.

    Keys without a value, or without an identity, are not filed. One aggregation, combined before the shuffle.
    """
    rows = []
    for rank, step in enumerate(steps):
        kind = F.col("kind") if "kind" in step.keys.columns else F.lit(step.kind)
        claim = F.struct(F.lit(rank).alias("rank"), F.lit(step.name).alias("step"), kind.alias("kind"))
        rows.append(step.keys.select("ns", F.col("val").cast("string").alias("val"), F.col("identity_id").cast("long").alias("identity_id"), claim.alias("claim")))
    claims = reduce(DataFrame.unionByName, rows).filter("val is not null and val <> '' and identity_id is not null")
    return claims.groupBy("ns", "val", "identity_id").agg(F.min("claim").alias("claim")).select("ns", "val", "identity_id", "claim.step", "claim.kind")


def keys_of(rows: DataFrame, ns: str, val: Column | str, identity: str, kind: str | None = None) -> DataFrame:
    """One namespace's keys of a table."""
    one = rows.select(F.lit(ns).alias("ns"), (F.col(val) if isinstance(val, str) else val).cast("string").alias("val"), F.col(identity).cast("long").alias("identity_id"))
    return one.withColumn("kind", F.lit(kind)) if kind else one


def merged(records: DataFrame, index: DataFrame, identities: DataFrame, gate: Column, fits: Column, base: int) -> DataFrame:
    """(record_id, identity_id, kind) of another catalogue's records: the best accepted identity of the same name, else one of its own.

    records: record_id, key (the name as a key) and further columns; identities: identity_id and further columns of
    other names; `gate` (struct(ok, score)) and `fits` read the further columns. A name that misses never takes a
    neighbour: such a record gets base + record_id. Of equal scores the smaller identity is taken.

    What is alike in all further columns is judged once: only kinds of records meet kinds of identities, under one name.
    """
    own, theirs = ([c for c in t.columns if c not in ("record_id", "identity_id", "key")] for t in (records, identities))
    named = index.filter(F.col("ns").isin("name", "alias")).select(F.col("val").alias("key"), "identity_id").distinct()
    kinds = named.join(identities, "identity_id").groupBy("key", *theirs).agg(F.min("identity_id").alias("identity_id"))
    asked = records.filter("key is not null and key <> ''").groupBy("key", *own).agg(F.count(F.lit(1)).alias("_n"))
    judged = asked.join(kinds, "key").filter(fits).withColumn("_g", gate).filter("_g.ok")
    best = judged.groupBy("key", *own).agg(F.max(F.struct(F.col("_g.score").alias("score"), (-F.col("identity_id")).alias("id"))).alias("_b"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", *own)]
    both = records.alias("r").join(best.alias("b"), same, "left").select("r.record_id", (-F.col("b._b.id")).alias("found"))
    return both.select("record_id", F.coalesce("found", F.col("record_id") + F.lit(base)).cast("long").alias("identity_id"), F.when(F.col("found").isNull(), EXACT).otherwise(DERIVED).alias("kind"))


def kind_of(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ns, val) with the identities of the key and their kinds; null where the index doesn't know it."""
    return asked.join(index.select("ns", "val", "identity_id", "kind"), ["ns", "val"], "left")


def learn(pairs: DataFrame, known: DataFrame, base: int) -> DataFrame:
    """(find, ns, val, identity_id, minted): what searches found, bound to identities.

    pairs: (find, ns, val), all that one search established about one game. Finds that share a key, at any
    distance, are one game. It has the smallest identity that one of its keys is known under (known: ns, val,
    identity_id), else a new one: base and its smallest find. Finds and keys that are null are left out.
    """
    rows = pairs.dropna(subset=["find", "ns", "val"]).select("find", "ns", F.col("val").cast("string").alias("val")).distinct()
    of = components(rows.select("find", F.struct("ns", "val").alias("key")), "find", "key")
    placed = rows.join(of, "find")
    hits = placed.join(known.select("ns", F.col("val").cast("string").alias("val"), F.col("identity_id").alias("_known")), ["ns", "val"])
    bound = hits.groupBy("component").agg(F.min("_known").alias("_known"))
    return placed.join(bound, "component", "left").select("find", "ns", "val", F.coalesce("_known", F.col("component") + F.lit(base)).cast("long").alias("identity_id"), F.col("_known").isNull().alias("minted"))
