"""What the platform gives beyond a catalog's own needs: grouping sets, windows of time, sketches, set operations, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.sources.tables import table

from .registry import query


@query("select l_returnflag, l_linestatus, count(*) as n, grouping_id(l_returnflag, l_linestatus)::bigint as g from lineitem group by rollup(l_returnflag, l_linestatus)")
def rollup_platform_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by cube(l_returnflag, l_linestatus)")
def cube_platform_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("select l_returnflag, l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linenumber), ())")
def grouping_sets_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag")], [F.col("l_linenumber")], []], F.col("l_returnflag"), F.col("l_linenumber")).agg(F.count(F.lit(1)).alias("n"))


@query()
def approx_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate by its nature: no SQL has the same sketch."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(12))).alias("users_hll"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("select start, count(*) as n from (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as start from events) group by 1")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")  # fmt: skip
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'P')
select 'both' as part, k from (select k from a intersect select k from b) union all select 'first', k from (select k from a except select k from b) union all select 'any', k from (select k from a union select k from b)""")  # fmt: skip
def union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FP")
    parts = {"both": a.intersect(b), "first": a.exceptAll(b), "any": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), "k")
        out = one if out is None else out.union(one)
    return out


@query("""select p.event_id, v.event_id as view_id from (select *, epoch_us(ts) as u from events where event_type = 'purchase') p asof left join (select user_id, ts, min(event_id) as event_id from events where event_type = 'view' group by all) v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides in one window by user and time: the last view before each purchase is carried along, no pairs are made."""
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')")
    view = F.col("event_type") == "view"
    w = Window.partitionBy("user_id").orderBy("ts", F.when(view, 0).otherwise(1), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("view_id", F.last(F.when(view, F.col("event_id")), ignorenulls=True).over(w))
    return rows.filter(~view).select("event_id", "view_id")
