"""Keeping folded entries in step with decisions: only what a decision touches is folded again.

Rows and entries are stored by buckets of their keys. A decision (a merge of two keys, or rows split off
to a key of their own) touches few keys; their buckets are read, their rows get the keys that they have
now and are folded as a full build folds all, so that patched and rebuilt are the same by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.titles import norm

from .graphs import resolve_aliases

BUCKETS = 64
Fold = Callable[[DataFrame], DataFrame]


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store(rows: DataFrame, path: str, key: str = "norm_key", buckets: int = BUCKETS) -> DataFrame:
    """rows as a table with a folder for each bucket of keys, which a filter on `bucket` prunes."""
    rows.withColumn("bucket", bucket_of(F.col(key), buckets)).write.partitionBy("bucket").parquet(path)
    return stored(rows.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def moved(rows: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """rows under the keys that decisions give them.

    splits: (norm_key, source, source_id, to), rows that go to a key of their own; merges: (alias, target),
    keys that are another's, followed to their ends (aliases in a circle stay as they are). Splits come
    first, so a row that was split off goes on if its new key is merged.
    """
    off = splits.select("norm_key", "source", "source_id", F.col("to").alias("_to")).dropDuplicates(["norm_key", "source", "source_id"])
    ends = resolve_aliases(merges).select(F.col("alias").alias("norm_key"), F.col("target").alias("_target"))
    columns = rows.columns
    first = rows.join(off, ["norm_key", "source", "source_id"], "left").withColumn("norm_key", F.coalesce("_to", "norm_key")).drop("_to")
    return first.join(ends, "norm_key", "left").withColumn("norm_key", F.coalesce("_target", "norm_key")).select(*columns)


def touched(merges: DataFrame, splits: DataFrame) -> DataFrame:
    """(norm_key) of every key that decisions take rows from or give rows to, or lead through."""
    keys = [merges.select(F.col("alias").alias("norm_key")), merges.select("target"), splits.select("norm_key"), splits.select("to")]
    out = keys[0]
    for k in keys[1:]:
        out = out.union(k)
    return out.filter("norm_key is not null").distinct()


@dataclass
class Patch:
    """keys: those touched; rows and entries: all that there is of them now."""

    keys: DataFrame
    rows: DataFrame
    entries: DataFrame

    def over(self, table: DataFrame, new: DataFrame) -> DataFrame:
        """A stored table with what the patch makes of its keys."""
        columns = [c for c in new.columns if c != "bucket"]
        return table.select(*columns).join(self.keys, "norm_key", "left_anti").unionByName(new.select(*columns))


def patch(rows: DataFrame, merges: DataFrame, splits: DataFrame, fold: Fold, buckets: int = BUCKETS) -> Patch:
    """What stored rows and their entries become by new decisions; reads the buckets of the touched keys only.

    fold: rows to entries, as for a full build. A null key is never touched. Decisions about keys that no
    row has change nothing; a key whose rows all leave has no entry any more.
    """
    keys = touched(merges, splits)
    read = [r.bucket for r in keys.select(bucket_of(F.col("norm_key"), buckets).alias("bucket")).distinct().collect()]  # `buckets` numbers at most
    some = rows.filter(F.col("bucket").isin(read)).join(keys, "norm_key", "left_semi").drop("bucket")
    now = moved(some, merges, splits)
    return Patch(keys, now, fold(now))


def folded_attributes(attrs: DataFrame, merges: DataFrame) -> DataFrame:
    """(norm_key, platform, kind, value, origin) under merged keys: of a kind, what the key has itself stays, else what comes from the smallest key that has it."""
    ends = resolve_aliases(merges).select(F.col("alias").alias("norm_key"), "target")
    rows = attrs.join(ends, "norm_key", "left").select(F.coalesce("target", "norm_key").alias("key"), "platform", "kind", "value", "origin", F.struct(F.col("target").isNotNull().alias("moved"), F.col("norm_key").alias("from")).alias("_from"))
    first = rows.groupBy("key", "platform", "kind").agg(F.min("_from").alias("_first"))
    kept = rows.alias("r").join(first.alias("f"), [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("key", "platform", "kind")]).filter("r._from = f._first")
    return kept.select(F.col("r.key").alias("norm_key"), "r.platform", "r.kind", "r.value", "r.origin").distinct()


def restamped(media: DataFrame, entries: DataFrame, resolutions: DataFrame) -> DataFrame:
    """media (asset_id, norm_key, system, provider, meta, game_key) with the identity that the catalog gives it now.

    The catalog decides for art of no console where all entries of a key agree: it takes their identity, and art
    that its provider filed under another is dropped. What still has no identity takes the resolved one
    (resolutions: norm_key, igdb_id, bundle; a bundle's is refused), else its title's.
    """
    of = entries.groupBy("norm_key").agg(F.min(F.coalesce("game_key", F.lit(""))).alias("_one"), F.max(F.coalesce("game_key", F.lit(""))).alias("_last")).filter("_one = _last and _one <> ''").drop("_last")
    known = resolutions.filter("igdb_id > 0 and not bundle").groupBy("norm_key").agg(F.min("igdb_id").alias("_igdb"))
    rows = media.join(of, "norm_key", "left").join(known, "norm_key", "left")
    neutral = (F.coalesce("system", F.lit("")) == "") & F.col("_one").isNotNull()
    foreign = neutral & (F.col("provider") == "igdb") & (F.coalesce("meta", F.lit("")) != "") & F.startswith("_one", F.lit("igdb:")) & (F.concat(F.lit("igdb:"), F.col("meta")) != F.col("_one"))
    stamp = F.when(neutral, F.col("_one")).otherwise(F.nullif("game_key", F.lit("")))
    stamp = F.coalesce(stamp, F.concat(F.lit("igdb:"), F.col("_igdb").cast("string")), F.concat(F.lit("title:"), F.col("norm_key")))
    return rows.filter(~F.coalesce(foreign, F.lit(False))).withColumn("game_key", stamp).drop("_one", "_igdb").select(*media.columns)


# What stands before a subtitle.
SEPARATORS = (":", " - ", " – ", " — ")


def head_of(title: Column) -> Column:
    """A title before its first subtitle separator; empty where it has none or begins with it."""
    t = F.trim(F.coalesce(title, F.lit("")))
    at = F.array_min(F.filter(F.array(*(F.instr(t, s) for s in SEPARATORS)), lambda i: i > 1))
    return F.coalesce(F.trim(F.substring(t, F.lit(1), at - 1)), F.lit(""))


def credited(members: DataFrame, owned: DataFrame, siblings: DataFrame) -> DataFrame:
    """members (coll_key, member_title, member_key, member_id) with `key`, the entry that a membership credits, and `by`.

    An entry of the same identity comes first (owned: identity_id, base_key), then a sibling of the same purchase
    that the member's title begins with as a whole (siblings: coll_key, sibling), else the member's own key.
    """
    mine = owned.groupBy(F.col("identity_id").alias("member_id")).agg(F.min("base_key").alias("_own"))
    rows = members.join(mine, "member_id", "left").withColumn("_head", norm(head_of(F.col("member_title"))))
    near = siblings.select("coll_key", F.col("sibling").alias("_head"), F.lit(True).alias("_near")).distinct()
    rows = rows.join(near, ["coll_key", "_head"], "left")
    by_id = F.col("_own").isNotNull() & (F.col("_own") != F.col("member_key"))
    by_head = F.coalesce("_near", F.lit(False)) & (F.col("_head") != "") & (F.col("_head") != F.col("member_key"))
    return rows.select(*members.columns, F.when(by_id, F.col("_own")).when(by_head, F.col("_head")).otherwise(F.col("member_key")).alias("key"), F.when(by_id, "identity").when(by_head, "sibling").otherwise("self").alias("by"))


def purchase_siblings(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """(coll_key, sibling): entries that were granted by the same purchase, itself among them.

    owned: (base_key, product) of what is owned directly. An inverted list: an asked entry's products lead to
    the entries that have them, so that entries are never compared with one another.
    """
    lists = owned.filter("product is not null").distinct()
    mine = asked.select("coll_key").distinct().join(lists.select(F.col("base_key").alias("coll_key"), "product"), "coll_key")
    return mine.join(lists, "product").select("coll_key", F.col("base_key").alias("sibling")).distinct()
