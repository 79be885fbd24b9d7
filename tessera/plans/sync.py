"""Sync queries: three-way merges, upserts, sweeps, inventories and publishing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import sync as Y, publishing as B
from tessera.sources.tables import table

from .registry import query

_SIDES_SQL = """o as (select o_orderkey as k, o_orderpriority as p, cast(o_orderkey % 5 as varchar) as s, epoch(o_orderdate)::double as ts from orders),
  local as (select k, sha1(p || chr(31) || case when k % 6 = 0 then 'x' else s end) as hash, ts from o where k % 7 <> 0), remote as (select k, sha1(p || chr(31) || case when k % 4 = 0 then 'y' else s end) as hash, ts + (k % 3 - 1) as ts from o where k % 11 <> 0),
  shadow as (select k, sha1(p || chr(31) || s) as hash from o where k % 13 <> 0)"""


@query(f"""with {_SIDES_SQL}, j as (select k, l.hash as lh, r.hash as rh, s.hash as sh, l.ts as lt, r.ts as rt from local l full join remote r using (k) full join shadow s using (k)),
d as (select *, lh is not distinct from rh as same, case when lh is distinct from sh and rh is not distinct from sh then true when rh is distinct from sh and lh is not distinct from sh then false when lh is null then false when rh is null then true else coalesce(lt, 0) >= coalesce(rt, 0) end as mine from j)
select k, case when same then 'same' when mine and lh is null then 'delete_remote' when mine then 'write_remote' when rh is null then 'delete_local' else 'write_local' end as action, case when same or mine then lh else rh end as hash from d""")  # fmt: skip
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 5).cast("string").alias("s"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"))
    side = lambda c, changed: o.filter(c).withColumn("s", changed).withColumn("hash", Y.content_hash(["p", "s"]))
    local = side("k % 7 <> 0", F.when(F.col("k") % 6 == 0, "x").otherwise(F.col("s")))
    remote = side("k % 11 <> 0", F.when(F.col("k") % 4 == 0, "y").otherwise(F.col("s"))).withColumn("ts", F.col("ts") + F.col("k") % 3 - 1)
    return Y.three_way(local, remote, side("k % 13 <> 0", F.col("s")), "k")


@query("""select coalesce(a.k, b.k) as k, case when b.k is not null then b.name else a.name end as name, coalesce(a.note, b.note) as note from (select c_custkey as k, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as note from customer where c_custkey % 3 > 0) a
full join (select c_custkey as k, 'new ' || c_name as name, 'n' || c_nationkey as note from customer where c_custkey % 5 > 0) b on a.k = b.k""")  # fmt: skip
def upsert_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("note"))
    new = c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("new "), "c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("note"))
    return Y.upsert(old, new, "k", ["name"], ["note"])


@query("select o_orderkey, o_orderpriority from orders where not (starts_with(o_orderpriority, '1-') and o_orderkey % 10 <> 3)")
def mark_and_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("stamp", F.col("o_orderkey") % 10)
    return Y.sweep(o, "stamp", 3, F.col("o_orderpriority").startswith("1-")).select("o_orderkey", "o_orderpriority")


@query("""select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'gone' when a.n = b.n and a.s = b.s then 'same' else 'changed' end as status
from (select doc_id, n_chars as n, source as s from documents where doc_id % 3 > 0) a full join (select doc_id, n_chars + case when doc_id % 8 = 0 then 1 else 0 end as n, source as s from documents where doc_id % 4 > 0 or doc_id % 8 = 0) b using (doc_id)""")  # fmt: skip
def file_inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    known = d.filter("doc_id % 3 > 0").select("doc_id", F.col("n_chars").alias("n"), F.col("source").alias("s"))
    seen = d.filter("doc_id % 4 > 0 or doc_id % 8 = 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0)).alias("n"), F.col("source").alias("s"))
    return Y.inventory(known, seen, "doc_id", ["n", "s"])


@query("""select lower(p_type) as system, lower(p_name) as game, count(*) as files from part p where p_partkey % 2 = 0 and not exists (select 1 from part a where a.p_partkey % 5 = 1 and lower(a.p_type) = lower(p.p_type) and lower(a.p_name) = lower(p.p_name)) group by all""")
def device_archive_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("system"), F.lower("p_name").alias("game"))
    device, archive = p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 5 = 1").select("system", "game")
    return device.join(archive, ["system", "game"], "left_anti").groupBy("system", "game").agg(F.count(F.lit(1)).alias("files"))


@query("select distinct k from (select p_partkey as k from part where p_type = 'PROMO' union select p_partkey from part where p_size = 7) where k not in (select p_partkey from part where p_brand = 'Brand#12')")
def publish_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    return Y.effective(p.filter("p_type = 'PROMO'"), p.filter("p_size = 7"), p.filter("p_brand = 'Brand#12'"), "k")


_PLAN_SQL = """w as (select p_partkey as k, p_name || ':' || p_size as sig, p_size * 1000 as bytes from part where p_partkey % 3 > 0), l as (select p_partkey as k, p_name || ':' || case when p_partkey % 5 = 0 then 0 else p_size end as done_sig from part where p_partkey % 4 > 0), g as (select p_partkey as k, true as gone from part where p_partkey % 9 = 1),
  j as (select coalesce(w.k, l.k) as k, w.k is not null as wanted, l.k is not null as done, sig, done_sig, bytes from w full join l on w.k = l.k), p as (select j.*, coalesce(gone, false) as gone from j left join g using (k)),
  plan as (select k, case when wanted and (not done or gone) then 'copy' when wanted and sig is distinct from done_sig then 'update' when wanted then 'skip' when gone then 'skip' else 'remove' end as action,
    case when wanted and not done then 'not on the target' when wanted and gone then 'published, but gone from the target' when wanted and sig is distinct from done_sig then 'the source has changed' when wanted then 'unchanged' when gone then 'not wanted, and already gone' else 'not wanted any more' end as reason, coalesce(bytes, 0)::bigint as bytes from p)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    sig = lambda size: F.concat_ws(":", "p_name", size.cast("string"))
    want = p.filter("k % 3 > 0").select("k", sig(F.col("p_size")).alias("sig"), (F.col("p_size") * 1000).alias("bytes"))
    done = p.filter("k % 4 > 0").select("k", sig(F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("p_size"))).alias("done_sig"))
    return Y.plan(want, done, p.filter("k % 9 = 1").select("k"), "k")


@query(f"with {_PLAN_SQL} select * from plan")
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"with {_PLAN_SQL} select action, count(*) as n, sum(bytes)::bigint as bytes, sum(case when action in ('copy', 'update') then bytes else 0 end)::bigint as to_write from plan group by 1")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    write = F.when(F.col("action").isin("copy", "update"), F.col("bytes")).otherwise(0)
    return _plan(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(write).alias("to_write"))


@query("select o_custkey, o_orderkey from orders where o_orderstatus = 'O' and not exists (select 1 from orders d where d.o_orderstatus = 'F' and d.o_custkey = orders.o_custkey)")
def ledger_expand_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").join(o.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti").select("o_custkey", "o_orderkey")


@query("""select o_orderkey, member, o_custkey = owner as owned from (select o_orderkey, o_custkey, unnest(list_distinct(list_sort(list(l_partkey % 50)))) as member, any_value(o_custkey) as owner from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)""")
def bundle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    b = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.sort_array(F.collect_set(F.col("l_partkey") % 50)).alias("members"))
    return b.select("o_orderkey", F.explode("members").alias("member"), F.lit(True).alias("owned"))


@query("""select p_partkey as member, count(distinct o_orderkey) as collections, min(o_orderkey) as first from part join lineitem on l_partkey = p_partkey join orders on o_orderkey = l_orderkey and o_orderstatus = 'F' group by 1""")
def collection_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), table(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("member")).agg(F.countDistinct("o_orderkey").alias("collections"), F.min("o_orderkey").alias("first"))


@query("""with x as (select l_orderkey as coll, l_partkey as part, o_orderstatus as role from lineitem join orders on o_orderkey = l_orderkey), m as (select distinct coll, part from x where role = 'F'),
f as (select m.*, exists (select 1 from x where x.part = m.part and x.role = 'O') as owned, exists (select 1 from x where x.part = m.part and x.role = 'P') as wished from m)
select coll, part, case when owned then 'standalone' when wished then 'satisfied' else 'created' end as status, case when not owned then 'via:' || coll end as via from f""")  # fmt: skip
def materialize_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has a role: collection (F), owned (O) or wished (P)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("coll"), F.col("l_partkey").alias("part"), F.col("o_orderstatus").alias("role"))
    flags = x.groupBy("part").agg(F.max(F.col("role") == "O").alias("owned"), F.max(F.col("role") == "P").alias("wished"))
    rows = x.filter("role = 'F'").select("coll", "part").distinct().join(flags, "part")
    return rows.select("coll", "part", F.when(F.col("owned"), "standalone").when(F.col("wished"), "satisfied").otherwise("created").alias("status"), F.when(~F.col("owned"), F.concat(F.lit("via:"), F.col("coll").cast("string"))).alias("via"))


@query("select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3 as kept from customer")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(w) <= 3).alias("kept"))


# orders are entries that are wanted on a customer's device; their line items are discs
_ITEMS_SQL = """want as (select o_orderkey as key from orders where o_orderstatus <> 'P' union all select o_orderkey + 10000000 from orders where o_orderkey % 50 = 0), entries as (select o_orderkey as key, ['snes', 'psx', 'pc'][o_custkey % 3 + 1] as system from orders),
files as (select l_orderkey as key, l_linenumber as disc, ['bin', 'iso', 'zip'][l_suppkey % 3 + 1] as ext, cast(sum(cast(floor(l_quantity) as bigint)) as varchar) as sig, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as bytes from lineitem where l_orderkey % 17 > 0 group by all),
ledger as (select l_orderkey as key, cast(max(cast(floor(l_quantity) as bigint)) as varchar) as sig from lineitem where l_orderkey % 3 = 0 group by 1), gone as (select o_orderkey as key from orders where o_orderkey % 9 = 0),
formats(system, ext, target_ext, tool) as (values ('psx', 'bin', 'chd', 'chdman'), ('psx', 'iso', 'chd', 'chdman'), ('pc', 'iso', 'cso', 'ciso')),
j as (select w.key, e.system, f.disc, f.sig, f.bytes, m.target_ext, m.tool, l.key is not null as led, l.sig as done, g.key is not null as gone, e.key is not null as known from want w left join entries e using (key) left join files f using (key) left join formats m on m.system = e.system and m.ext = f.ext left join ledger l using (key) left join gone g using (key)),
b as (select *, case when not known then 'unknown entry' when disc is null then 'no source file' when tool = 'ciso' then 'ciso not available' end as blocker from j),
items as (select key, disc, case when blocker is not null then 'blocked' when not led or gone then case when tool is null then 'copy' else 'convert' end when sig is distinct from done then 'update' else 'skip' end as action,
case when not known then 'entry is not in the catalog' when disc is null then 'no file of it is known' when not led then 'not present on the target' when gone then 'published, but not on the target now' when sig is distinct from done then 'source changed since it was published' else 'unchanged' end as reason,
case when disc is not null then tool end as tool, target_ext, coalesce(bytes, 0) as bytes, blocker from b
union all select key, null, case when g.key is not null then 'skip' else 'remove' end, case when g.key is not null then 'not wanted any more, and already gone' else 'not wanted any more' end, null, null, 0, null from ledger left join gone g using (key) where key not in (select key from want))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").alias("key")
    want = o.filter("o_orderstatus <> 'P'").select(key).unionByName(o.filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10_000_000).alias("key")))
    system, ext = (F.array(*map(F.lit, names))[F.expr(at)] for names, at in ((("snes", "psx", "pc"), "cast(o_custkey % 3 as int)"), (("bin", "iso", "zip"), "cast(l_suppkey % 3 as int)")))
    whole = lambda c: F.floor(c).cast("long")
    files = li.filter("l_orderkey % 17 > 0").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("disc"), ext.alias("ext")).agg(F.sum(whole("l_quantity")).cast("string").alias("sig"), F.sum(whole("l_extendedprice")).alias("bytes"))
    ledger = li.filter("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.max(whole("l_quantity")).cast("string").alias("sig"))
    formats = spark.createDataFrame([("psx", "bin", "chd", "chdman"), ("psx", "iso", "chd", "chdman"), ("pc", "iso", "cso", "ciso")], "system string, ext string, target_ext string, tool string")
    tools = spark.createDataFrame([("chdman",)], "tool string")
    return B.items(want, o.select(key, system.alias("system")), files, ledger, o.filter("o_orderkey % 9 = 0").select(key), formats, tools)


@query(f"with {_ITEMS_SQL} select * from items")
def publish_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


@query(f"with {_ITEMS_SQL}, n as (select o_custkey as device, sum(case when action in ('copy', 'convert', 'update') then bytes else 0 end) as need from items join orders on o_orderkey = key group by 1), f as (select c_custkey as device, cast(floor(c_acctbal * 50) as bigint) as free from customer where c_custkey % 7 > 0) select device, cast(need as bigint) as need, free, coalesce(need > free, false) as over from n left join f using (device)")
def publish_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _items(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("device")), "key")
    free = table(spark, sf_dir, "customer").filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("device"), F.floor(F.col("c_acctbal") * 50).cast("long").alias("free"))
    return B.capacity(planned, free, "device")


@query("select o_custkey as target, 'g' || o_orderkey as path from orders where o_orderkey % 5 > 1 and not (o_orderkey % 5 = 2 and o_orderkey % 2 = 0)")
def publish_unmanaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen on targets, less what was put there, as itself or as a further path of another."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 5).alias("r"), F.col("o_orderkey").alias("k"))
    extra = o.filter("r = 2 and k % 2 = 0").groupBy("target").agg(F.collect_list("path").alias("extra"))
    main = o.filter("r < 2").select("target", "path", F.lit(None).cast("array<string>").alias("extra"))
    return B.unmanaged(o.select("target", "path"), main.unionByName(extra.select("target", F.lit("none").alias("path"), "extra")))
