"""Queries that build the handle index and tie what is one game."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import gate, titles as T
from tessera.operators import graphs as G, index as X
from tessera.sources.tables import table

from . import adapters as A
from .identity import gate_sql
from .registry import query

OWN, LEARNED = 4_000_000_000, 8_000_000_000
# orders as finds: what one customer ordered in a month, and four neighbouring orders, are tied
_PAIRS_SQL = """pairs as (select o_orderkey as find, 'month' as ns, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') as val from orders union all select o_orderkey, 'block', cast(o_orderkey // 4 as varchar) from orders)"""
_REACH_SQL = f"""{_PAIRS_SQL}, tie as (select distinct a.find as a, b.find as b from pairs a join pairs b using (ns, val)), reach as (select find, find as other from pairs union select r.find, t.b from reach r join tie t on t.a = r.other),
comp as (select find, min(other) as component from reach group by find)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM"))
    keys = F.array(F.struct(F.lit("month").alias("ns"), month.alias("val")), F.struct(F.lit("block").alias("ns"), F.expr("cast(o_orderkey div 4 as string)").alias("val")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("find"), F.inline(keys))


@query(f"with recursive {_REACH_SQL} select find, component from comp")
def shared_key_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_pairs(spark, sf_dir).select("find", F.struct("ns", "val").alias("key")), "find", "key")


@query(f"""with recursive {_REACH_SQL}, known as (select 'block' as ns, cast(c_custkey as varchar) as val, c_custkey * 3 as identity_id from customer where c_custkey % 5 = 0),
bound as (select component, min(identity_id) as known from pairs join comp using (find) join known using (ns, val) group by 1)
select find, ns, val, coalesce(known, component + {LEARNED}) as identity_id, known is null as minted from pairs join comp using (find) left join bound using (component)""")  # fmt: skip
def index_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.lit("block").alias("ns"), F.col("c_custkey").cast("string").alias("val"), (F.col("c_custkey") * 3).alias("identity_id"))
    return X.learn(_pairs(spark, sf_dir), known, LEARNED)


# parts with an even key are the catalogue that identities come from, the others a second one, matched by name and brand
_INDEX_SQL = f"""{A.TITLES_SQL}, named as (select *, {A.norm_sql('title_raw')} as key, {A.norm_sql('p_name')} as alias from titles), even as (select * from named where p_partkey % 2 = 0), odd as (select * from named where p_partkey % 2 = 1),
spine as (select 'first' as ns, cast(p_partkey as varchar) as val, p_partkey as identity_id, 0 as rank, 'spine' as step, 'exact' as kind from even union all select 'name', key, p_partkey, 1, 'names', 'derived' from even union all select 'alias', alias, p_partkey, 2, 'aliases', 'derived' from even
  union all select 'store', cast(l_orderkey * 10 + l_linenumber as varchar), l_partkey, 3, 'stores', 'exact' from lineitem where l_returnflag = 'N' and l_partkey % 2 = 0),
pairs as (select distinct o.p_partkey as record_id, e.p_partkey as identity_id, o.title_raw as t, e.title_raw as u from odd o join spine k on k.ns in ('name', 'alias') and k.val = o.key and o.key <> '' join even e on e.p_partkey = k.identity_id where e.p_brand = o.p_brand),
{gate_sql('pairs', 't', 'u')}, best as (select record_id, -max((score, -identity_id))[2] as found from q3 where ok group by 1),
merged as (select p_partkey as record_id, key, coalesce(found, p_partkey + {OWN}) as identity_id, case when found is null then 'exact' else 'derived' end as kind from odd left join best on record_id = p_partkey),
claims as (select * from spine union all select 'second', cast(record_id as varchar), identity_id, 4, 'second', kind from merged union all select 'name', key, identity_id, 5, 'second names', 'derived' from merged where identity_id >= {OWN}
  union all select 'store', cast(l_orderkey * 10 + l_linenumber as varchar), identity_id, 6, 'second stores', 'exact' from lineitem join merged on record_id = l_partkey),
idx as (select ns, val, identity_id, min((rank, step, kind)) as c from claims where val <> '' group by all)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.titles(spark, sf_dir).withColumns({"key": T.norm(F.col("title_raw")), "alias": T.norm(F.col("p_name"))})
    even, odd = t.filter("p_partkey % 2 = 0"), t.filter("p_partkey % 2 = 1")
    li = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    spine = [
        X.Step("spine", X.keys_of(even, "first", "p_partkey", "p_partkey")), X.Step("names", X.keys_of(even, "name", "key", "p_partkey"), X.DERIVED), X.Step("aliases", X.keys_of(even, "alias", "alias", "p_partkey"), X.DERIVED),
        X.Step("stores", X.keys_of(li.filter("l_returnflag = 'N' and l_partkey % 2 = 0"), "store", "line", "l_partkey")),
    ]
    names = reduce(DataFrame.unionByName, [s.keys for s in spine[1:3]])
    records = odd.select(F.col("p_partkey").alias("record_id"), "key", gate.features(F.col("title_raw")).alias("t"), F.col("p_brand").alias("brand"))
    identities = even.select(F.col("p_partkey").alias("identity_id"), gate.features(F.col("title_raw")).alias("u"), "p_brand")
    merged = X.merged(records, names, identities, gate.judged_features(F.col("t"), F.col("u")), F.col("brand") == F.col("p_brand"), OWN)
    theirs = merged.select(F.lit("second").alias("ns"), F.col("record_id").cast("string").alias("val"), "identity_id", "kind")
    minted = odd.select(F.col("p_partkey").alias("record_id"), "key").join(merged.filter(F.col("identity_id") >= OWN), "record_id")
    lines = li.join(merged.select(F.col("record_id").alias("l_partkey"), "identity_id"), "l_partkey")
    return X.build([*spine, X.Step("second", theirs), X.Step("second names", X.keys_of(minted, "name", "key", "identity_id"), X.DERIVED), X.Step("second stores", X.keys_of(lines, "store", "line", "identity_id"))])


@query(f"with {_INDEX_SQL} select ns, val, identity_id, c[2] as step, c[3] as kind from idx")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(f"""with {_INDEX_SQL}, asked as (select distinct 'store' as ns, cast(l_orderkey * 10 + l_linenumber as varchar) as val from lineitem union all select 'second', cast(p_partkey as varchar) from part)
select ns, val, identity_id, c[3] as kind from asked left join idx using (ns, val)""")  # fmt: skip
def index_key_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.lit("store").alias("ns"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("val")).distinct()
    parts = table(spark, sf_dir, "part").select(F.lit("second").alias("ns"), F.col("p_partkey").cast("string").alias("val"))
    return X.kind_of(_index(spark, sf_dir), lines.unionByName(parts))
