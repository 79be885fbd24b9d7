"""Queries in SQL text over registered functions, XML libraries and links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import twins
from tessera.operators import links as L
from tessera.sources import xml
from tessera.sources.staging import shared_dir
from tessera.sources.tables import table

from . import adapters as A
from .identity import _KEYS_SQL, _keys, gate_sql
from .registry import query


@query(f"with {A.TITLES_SQL} select p_partkey, {A.norm_sql('title_raw')} as key, case when regexp_matches(title_raw, '\\((19|20)\\d\\d\\)') then cast(regexp_extract(title_raw, '\\(((?:19|20)\\d\\d)\\)', 1) as int) end as year, contains(title_raw, '[!]') as verified from titles")
def sql_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins.register(spark)
    named = A.titles(spark, sf_dir).selectExpr("p_partkey", "norm(title_raw) as key", "parse_name(title_raw) as p")
    return named.select("p_partkey", "key", "p.year", "p.verified")


@query(f"""with {A.TITLES_SQL}, pairs as (select p_partkey as a, title_raw as t, p_name as u from titles), {gate_sql('pairs', 't', 'u')} select a, ok, cast(round(score * 1000000) as bigint) as score from q3""")
def sql_gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins.register(spark)
    return spark.sql("select p_partkey as a, g.ok, cast(round(g.score * 1000000) as bigint) as score from (select p_partkey, gate_score(title_raw, p_name) as g from {t}) where g.ok is not null", t=A.titles(spark, sf_dir))


@query("""with r as (select l_partkey as k, l_quantity * 2 as s, case when l_linenumber % 3 = 0 then null else l_suppkey % 10 end as v, l_linenumber % 2 = 0 as critic from lineitem),
c as (select *, case when v is null then case when critic then 1.0::double else 0.5::double end else greatest(0.0::double, least(1.0::double, v / case when critic then 5.0::double else 400.0::double end)) end as c from r),
w as (select *, case when critic then 0.6::double else 1 - 0.6::double end * c as wt, c * s + (1 - c) * 70.0::double as adj from c),
t as (select k, sum(cast(round_even(wt * 1e6, 0) as bigint)) as w, sum(cast(round_even(wt * adj * 1e6, 0) as bigint)) as wa, sum(case when critic then cast(round_even(wt * 1e6, 0) as bigint) else 0 end) as wc from w group by k)
select k, cast(round_even(case when wc > 0 then wa::double / w else 0.6::double * (wa::double / w) + (1 - 0.6::double) * 70.0::double end, 0) as int) as score from t where w > 0""")  # fmt: skip
def sql_library_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins.register(spark)
    ratings = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as k", "if(l_linenumber % 2 = 0, 'critic', 'user') as kind", "l_quantity * 2 as score", "if(l_linenumber % 3 = 0, null, l_suppkey % 10) as votes")
    return spark.sql("select k, library_score(kind, cast(score as double), cast(votes as double)) as score from {r} group by k", r=ratings).filter("score is not null")


@query(f"""with {_KEYS_SQL}, k as (select *, case when ns = 'name' then 'derived' else 'exact' end as kind from keys), o as (select *, row_number() over (partition by identity_id order by ns, val) as place from k)
select identity_id, cast(place as int) as place, ns, val, ns || ' ' || val || ': ' || case kind when 'exact' then 'stated by its source' else 'concluded from a name' end as explanation from o
union all select identity_id, null, null, null, count(*) || ' keys of ' || count(distinct ns) || ' kinds, ' || count(*) filter (kind = 'exact') || ' stated' from k group by identity_id""")  # fmt: skip
def sql_explain_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins.register(spark)
    keys = _keys(spark, sf_dir).withColumn("kind", F.when(F.col("ns") == "name", "derived").otherwise("exact"))
    return spark.sql("select * from explain_handles(table({keys}) partition by identity_id order by (ns, val))", keys=keys)


@query("""with there as (select 'c' || c_custkey as id, c_name as title, c_mktsegment as foreign_note from customer where c_custkey % 3 > 0), ours as (select 'c' || c_custkey as id, upper(c_name) as title, case when c_acctbal > 0 then cast(c_nationkey as varchar) end as platform from customer where c_custkey % 2 = 0)
select id as "ID", coalesce(o.title, t.title) as "Title", foreign_note as "Custom", platform as "Platform" from there t full join ours o using (id)""")  # fmt: skip
def xml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library in XML is read, ours is written over it, and the whole is written and read again."""
    c = table(spark, sf_dir, "customer")
    id = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ID")
    root = f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"
    xml.write(c.filter("c_custkey % 3 > 0").select(id, F.col("c_name").alias("Title"), F.col("c_mktsegment").alias("Custom")), f"{root}/there", "LaunchBox", "Game")
    ours = c.filter("c_custkey % 2 = 0").select(id, F.upper("c_name").alias("Title"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).alias("Platform"))
    xml.write(xml.merged(xml.elements(spark, f"{root}/there", "Game"), ours, "ID"), f"{root}/after", "LaunchBox", "Game")
    return xml.elements(spark, f"{root}/after", "Game").select("ID", "Title", "Custom", "Platform")


PAGES = {"one": "https://one.example/game/%s", "two": "https://two.example/%s", "three": "https://three.example/g-%s/"}


@query("""with games as (select p_partkey as game_id, 'k' || p_partkey % 300 as norm_key, ['PC', 'snes', ' Switch '][p_partkey % 3 + 1] as platform from part),
ids as (select 'one' as provider, 'k' || s_suppkey as norm_key, cast(s_suppkey % 40 - 2 as varchar) as provider_id, null as platform from supplier union all select 'two', 'k' || s_suppkey, 'slug-' || s_suppkey || case when s_suppkey % 7 = 0 then '/x' else '' end, null from supplier where s_suppkey % 2 = 0
  union all select 'three', 'k' || s_suppkey, cast(s_suppkey * 10 as varchar), ['pc', 'switch', ''][s_suppkey % 3 + 1] from supplier union all select 'other', 'k' || s_suppkey, '5', null from supplier),
l as (select game_id, provider, provider_id from games g join ids i using (norm_key) where game_id % 11 > 0 and provider <> 'other' and not starts_with(provider_id, '-') and provider_id <> '0' and (provider <> 'three' or (i.platform <> '' and i.platform = trim(lower(g.platform)))))
select game_id, provider, provider_id, case when provider = 'two' then case when regexp_matches(provider_id, '^[A-Za-z0-9][A-Za-z0-9._-]{0,120}$') then 'https://two.example/' || provider_id end when provider = 'one' then 'https://one.example/game/' || provider_id else 'https://three.example/g-' || provider_id || '/' end as url from l""")  # fmt: skip
def link_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = lambda c: F.concat(F.lit("k"), c.cast("string")).alias("norm_key")
    n = F.col("s_suppkey")
    games = part.select(F.col("p_partkey").alias("game_id"), key(F.col("p_partkey") % 300), A.pick(["PC", "snes", " Switch "], "cast(p_partkey % 3 as int)").alias("platform"))
    none = F.lit(None).cast("string").alias("platform")
    ids = s.select(F.lit("one").alias("provider"), key(n), (n % 40 - 2).cast("string").alias("provider_id"), none)
    ids = ids.unionByName(s.filter("s_suppkey % 2 = 0").select(F.lit("two").alias("provider"), key(n), F.concat(F.lit("slug-"), n.cast("string"), F.when(n % 7 == 0, "/x").otherwise("")).alias("provider_id"), none))
    ids = ids.unionByName(s.select(F.lit("three").alias("provider"), key(n), (n * 10).cast("string").alias("provider_id"), A.pick(["pc", "switch", ""], "cast(s_suppkey % 3 as int)").alias("platform")))
    ids = ids.unionByName(s.select(F.lit("other").alias("provider"), key(n), F.lit("5").alias("provider_id"), none))
    return L.rebuilt(games, ids, games.filter("game_id % 11 = 0"), PAGES, keyed=["three"], slugs=["two"])
