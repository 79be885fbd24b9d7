"""Queries that patch a stored catalog; their SQL builds it anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import titles as T
from tessera.operators import catalog as C, patch as P
from tessera.sources.staging import shared_dir
from tessera.sources.tables import table

from . import adapters as A
from .registry import query

# two thirds of the titles with a numeral are merged into the plain name, some of which go on to another; some sources are split off
_MERGES_SQL = f"""plain as (select p_partkey, {A.norm_sql('p_name')} as key from part), marked as (select p_partkey, {A.norm_sql('title_raw', 'platform')} as key from titles where p_partkey % 16 = 3 and p_partkey % 3 > 0),
firsts as (select m.key as alias, min(p.key) as target from marked m join plain p using (p_partkey) group by 1), links as (select alias, target from firsts where alias <> target),
merges as (select alias, target from links union all select distinct target, 'the ' || target from links where target like 'b%'),
splits as (select distinct norm_key, source, source_id, norm_key || ' apart' as "to" from src where source = 'A' and k % 97 = 5),
ends as (select a.alias, coalesce(b.target, a.target) as target from merges a left join merges b on b.alias = a.target)"""
_MOVED_SQL = """first as (select src.* exclude (norm_key), coalesce(s."to", norm_key) as norm_key from src left join splits s using (norm_key, source, source_id)),
moved as (select first.* exclude (norm_key), coalesce(e.target, norm_key) as norm_key from first left join ends e on e.alias = norm_key)"""
_HEAD, _FOLDS = A.ROWS_SQL.split("  one as (", 1)
_REBUILT_SQL = f"{_HEAD} {_MERGES_SQL}, {_MOVED_SQL}, one as ({_FOLDS.replace('from src', 'from moved')}"


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = A.titles(spark, sf_dir)
    marked = t.filter("p_partkey % 16 = 3 and p_partkey % 3 > 0").select(T.norm(F.col("title_raw"), F.col("platform")).alias("alias"), T.norm(F.col("p_name")).alias("target"))
    links = marked.groupBy("alias").agg(F.min("target").alias("target")).filter("alias <> target")
    onward = links.filter("target like 'b%'").select(F.col("target").alias("alias"), F.concat(F.lit("the "), F.col("target")).alias("target")).distinct()
    rows = A.source_rows(spark, sf_dir)
    splits = rows.filter("source = 'A' and seq.k % 97 = 5").select("norm_key", "source", "source_id", F.concat("norm_key", F.lit(" apart")).alias("to")).distinct()
    return links.unionByName(onward), splits


def entries_of(rows: DataFrame) -> DataFrame:
    return C.fold_sources(rows, A.STORES)[1]


@query(f"with {_REBUILT_SQL} select norm_key, platform, title, n_sources, n_kinds, sources_summary, owned from entries")
def patch_merge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows and entries, patched by merges and splits: the entries of a full build with them."""
    root = f"{shared_dir(spark)}/patch-{uuid.uuid4().hex}"
    rows = P.store(A.source_rows(spark, sf_dir), f"{root}/rows")
    entries = P.store(entries_of(rows.drop("bucket")), f"{root}/entries")
    done = P.patch(rows, *_decisions(spark, sf_dir), entries_of)
    return done.over(entries, done.entries)


@query(f"""with {_HEAD} {_MERGES_SQL}, attrs as (select distinct norm_key, platform, case when p_size % 3 = 0 then 'genre' when p_size % 3 = 1 then 'maker' else 'series' end as kind, p_type as value, p_brand as origin from keyed),
m as (select coalesce(e.target, norm_key) as norm_key, platform, kind, value, origin, case when e.target is null then 0 else 1 end as moved, norm_key as "from" from attrs left join ends e on e.alias = norm_key)
select distinct norm_key, platform, kind, value, origin from m qualify rank() over (partition by norm_key, platform, kind order by moved, "from") = 1""")  # fmt: skip
def patch_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.titles(spark, sf_dir)
    kind = F.when(F.col("p_size") % 3 == 0, "genre").when(F.col("p_size") % 3 == 1, "maker").otherwise("series")
    attrs = t.select(T.norm(F.col("title_raw"), F.col("platform")).alias("norm_key"), "platform", kind.alias("kind"), F.col("p_type").alias("value"), F.col("p_brand").alias("origin")).distinct()
    return P.folded_attributes(attrs, _decisions(spark, sf_dir)[0])


# line items as art of parts: a quarter neutral; identities of parts that agree or not within a name
_MEDIA_SQL = """media as (select l_orderkey * 10 + l_linenumber as asset_id, 'k' || l_partkey % 500 as norm_key, case when l_linenumber % 4 = 0 then 'snes' else '' end as system, case when l_suppkey % 2 = 0 then 'igdb' else 'other' end as provider,
  case when l_suppkey % 3 = 0 then cast(l_partkey % 500 % 7 as varchar) else '' end as meta, case when l_quantity < 10 then '' when l_quantity < 20 then 'title:old' else 'igdb:' || l_partkey % 9 end as game_key from lineitem),
ent as (select 'k' || p_partkey % 700 as norm_key, case when p_partkey % 700 % 5 = 0 then 'title:k' || p_partkey % 700 when p_partkey % 700 % 5 = 1 and p_size > 25 then 'title:other' when p_partkey % 700 % 5 = 2 then null else 'igdb:' || p_partkey % 700 % 6 end as game_key from part),
res as (select 'k' || s_suppkey % 300 as norm_key, s_suppkey % 50 as igdb_id, s_nationkey % 4 = 0 as bundle from supplier)"""


@query(f"""with {_MEDIA_SQL}, agreed as (select norm_key, min(coalesce(game_key, '')) as one from ent group by 1 having count(distinct coalesce(game_key, '')) = 1 and min(coalesce(game_key, '')) <> ''),
known as (select norm_key, min(igdb_id) as igdb from res where igdb_id > 0 and not bundle group by 1)
select asset_id, norm_key, system, provider, meta, coalesce(case when system = '' and one is not null then one else nullif(game_key, '') end, 'igdb:' || igdb, 'title:' || norm_key) as game_key
from media left join agreed using (norm_key) left join known using (norm_key) where not coalesce(system = '' and provider = 'igdb' and meta <> '' and one like 'igdb:%' and 'igdb:' || meta <> one, false)""")  # fmt: skip
def media_restamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("k"), (F.col(c) % n).cast("string"))
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    media = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), name("l_partkey", 500).alias("norm_key"), F.when(F.col("l_linenumber") % 4 == 0, "snes").otherwise("").alias("system"), F.when(F.col("l_suppkey") % 2 == 0, "igdb").otherwise("other").alias("provider"),
        F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_partkey") % 500 % 7).cast("string")).otherwise("").alias("meta"),
        F.when(F.col("l_quantity") < 10, "").when(F.col("l_quantity") < 20, "title:old").otherwise(F.concat(F.lit("igdb:"), (F.col("l_partkey") % 9).cast("string"))).alias("game_key"),
    )
    n = F.col("p_partkey") % 700
    key = F.when(n % 5 == 0, F.concat(F.lit("title:k"), n.cast("string"))).when((n % 5 == 1) & (F.col("p_size") > 25), "title:other").when(n % 5 == 2, None).otherwise(F.concat(F.lit("igdb:"), (n % 6).cast("string")))
    entries = part.select(name("p_partkey", 700).alias("norm_key"), key.alias("game_key"))
    resolutions = table(spark, sf_dir, "supplier").select(name("s_suppkey", 300).alias("norm_key"), (F.col("s_suppkey") % 50).alias("igdb_id"), (F.col("s_nationkey") % 4 == 0).alias("bundle"))
    return P.restamped(media, entries, resolutions)


# orders as collections: the products that a customer has of a supplier, and members by titles of parts
_OWNED_SQL = """owned as (select distinct o_orderkey as base_key, o_custkey * 1000 + l_suppkey as product from orders join lineitem on l_orderkey = o_orderkey where l_linestatus = 'O'), asked as (select o_orderkey as coll_key from orders where o_orderstatus = 'O')"""


@query(f"with {_OWNED_SQL} select distinct a.coll_key, y.base_key as sibling from asked a join owned x on x.base_key = a.coll_key join owned y using (product)")
def purchase_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    owned = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("base_key"), (F.col("o_custkey") * 1000 + F.col("l_suppkey")).alias("product"))
    return P.purchase_siblings(o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("coll_key")), owned)


@query(f"""with {A.TITLES_SQL}, m as (select l_orderkey as coll_key, title_raw as member_title, {A.norm_sql('title_raw')} as member_key, l_suppkey as member_id from lineitem join titles on p_partkey = l_partkey),
own as (select s_suppkey as member_id, min(lower(s_name)) as own from supplier where s_suppkey % 10 = 0 group by 1), sib as (select distinct l_orderkey as coll_key, {A.norm_sql('p_name')} as head from lineitem join part on p_partkey = l_partkey where l_linenumber % 2 = 0),
h as (select *, {A.norm_sql("coalesce(trim(substring(trim(member_title), 1, list_min(list_filter([instr(trim(member_title), ':'), instr(trim(member_title), ' - '), instr(trim(member_title), ' – '), instr(trim(member_title), ' — ')], lambda i: i > 1)) - 1)), '')")} as head from m)
select h.coll_key, member_title, member_key, h.member_id, case when own is not null and own <> member_key then own when sib.head is not null and h.head <> '' and h.head <> member_key then h.head else member_key end as key,
case when own is not null and own <> member_key then 'identity' when sib.head is not null and h.head <> '' and h.head <> member_key then 'sibling' else 'self' end as by from h left join own using (member_id) left join sib on sib.coll_key = h.coll_key and sib.head = h.head""")  # fmt: skip
def member_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, li = A.titles(spark, sf_dir), table(spark, sf_dir, "lineitem")
    keyed = t.select("p_partkey", F.col("title_raw").alias("member_title"), T.norm(F.col("title_raw")).alias("member_key"), T.norm(F.col("p_name")).alias("plain"))
    lines = li.join(keyed, F.col("l_partkey") == F.col("p_partkey"))
    members = lines.select(F.col("l_orderkey").alias("coll_key"), "member_title", "member_key", F.col("l_suppkey").alias("member_id"))
    owned = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("identity_id"), F.lower("s_name").alias("base_key"))
    return P.credited(members, owned, lines.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("coll_key"), F.col("plain").alias("sibling")))
