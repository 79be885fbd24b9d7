"""Usage and score queries over events, and checks that finished data must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import scoring as R
from tessera.sources.tables import table

from .registry import QUERIES, query

_CENTS = "cast(round(value * 100) as bigint)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query(f"""with u as (select date_trunc('month', ts)::date as month, event_type as provider, sum({_CENTS})::bigint as tokens, count(*) as calls from events group by all)
select strftime(month, '%Y-%m-%d') as month, provider, tokens, calls, tokens * case provider when 'click' then 2 when 'view' then 3 when 'purchase' then 5 end as cost, provider in ('error', 'signup') as unpriced from u""")  # fmt: skip
def month_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 2), ("view", 3), ("purchase", 5)], "provider string, price long")
    u = events(spark, sf_dir).groupBy(F.trunc("ts", "month").alias("month"), F.col("event_type").alias("provider")).agg(F.sum("cents").alias("tokens"), F.count(F.lit(1)).alias("calls"))
    return u.join(F.broadcast(prices), "provider", "left").select(F.date_format("month", "yyyy-MM-dd").alias("month"), "provider", "tokens", "calls", (F.col("tokens") * F.col("price")).alias("cost"), F.col("price").isNull().alias("unpriced"))


@query(f"""select strftime(d, '%Y-%m-%d') as day, coalesce(c, 0)::bigint as cents from (select unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day)) as d) left join (select ts::date as d2, sum({_CENTS}) as c from events where event_type = 'purchase' group by 1) on d2 = d::date""")
def daily_series_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return R.dense_daily(e, "day", "cents", "2023-12-25", "2024-02-05").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""with u as (select user_id, sum({_CENTS})::bigint as used, bool_or(event_type = 'error') as unpriced from events group by 1) select user_id, used,
case when user_id % 4 = 0 then 'none' when unpriced and user_id % 3 = 0 then 'blocked' when used > 100000 then 'over' when used = 100000 then 'at' else 'under' end as verdict from u""")  # fmt: skip
def caps_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).groupBy("user_id").agg(F.sum("cents").alias("used"), F.max(F.col("event_type") == "error").alias("unpriced"))
    return u.select("user_id", "used", R.verdict(F.col("used"), F.when(F.col("user_id") % 4 != 0, 100000), F.col("unpriced") & (F.col("user_id") % 3 == 0)).alias("verdict"))


@query(f"select event_id, count(*) over w as calls, sum({_CENTS}) over w::bigint as cents from events window w as (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row)")
def rolling_hour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("calls"), F.sum("cents").over(w).alias("cents"))


@query("select user_id, event_type, max(ts) as last, max(ts) >= timestamp '2024-01-20 00:00:00' as fresh from events group by all")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return e.withColumn("fresh", F.col("last") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).filter("k > 50")


@query(f"""with d as (select user_id, event_type, count(*) as calls, sum({_CENTS})::bigint as cents, count(distinct ts::date) as days, sum(case when ts >= timestamp '2024-01-15 00:00:00' then 1 else 0 end)::bigint as recent from events group by all) select * from d""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.when(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 1).otherwise(0)
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("cents").alias("cents"), F.countDistinct(F.to_date("ts")).alias("days"), F.sum(recent).alias("recent"))


@query("""with r as (select user_id % 40 as game, case when event_type in ('purchase', 'signup') then 'critic' else 'user' end as kind, (round(value * 100) % 101)::double as score, case when event_id % 5 = 0 then null else event_id % 600 end as votes from events where user_id % 40 <> 7 or event_type = 'view'),
c as (select *, kind = 'critic' as cr, case when votes is null then case when kind = 'critic' then 1.0::double else 0.5::double end else greatest(0::double, least(1::double, votes / case when kind = 'critic' then 5.0::double else 400.0::double end)) end as c from r),
w as (select game, cr, round_even((case when cr then 0.6::double else (1 - 0.6::double) end * c) * 1e6::double, 0)::bigint as w, round_even((case when cr then 0.6::double else (1 - 0.6::double) end * c * (c * score + (1 - c) * 70.0::double)) * 1e6::double, 0)::bigint as wa from c),
s as (select game, sum(w)::bigint as w, sum(wa)::bigint as wa, sum(case when cr then w else 0 end)::bigint as wc, sum(case when cr then wa else 0 end)::bigint as wac, sum(case when cr then 0 else w end)::bigint as wu, sum(case when cr then 0 else wa end)::bigint as wau from w group by 1)
select game, cast(round_even(case when wc > 0 then wa::double / w else 0.6::double * (wa::double / w) + (1 - 0.6::double) * 70.0::double end, 0) as int) as universal, cast(round_even(case when wc > 0 then wac::double / wc end, 0) as int) as critic, cast(round_even(case when wu > 0 then wau::double / wu end, 0) as int) as "user" from s where w > 0""")  # fmt: skip
def bayes_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("user_id % 40 <> 7 or event_type = 'view'")
    r = e.select((F.col("user_id") % 40).alias("game"), F.when(F.col("event_type").isin("purchase", "signup"), "critic").otherwise("user").alias("kind"), (F.col("cents") % 101).cast("double").alias("score"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 600).alias("votes"))
    return R.bayes(r, "game")


@query("select user_id, event_type, ts, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) as k from events) where k <= 3")
def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("user_id", "event_type", "ts", "event_id")


@query(f"select event_type, median({_CENTS})::double as median, cast(quantile_disc({_CENTS}, 0.9) as bigint) as p90 from events group by 1")
def median_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.median("cents").alias("median"), F.expr("percentile_disc(0.9) within group (order by cents)").cast("long").alias("p90"))


@query(f"""with f as (select user_id, event_id, {_CENTS} < 2000 as low, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, {_CENTS} < 2000 order by event_id) as island from events),
g as (select user_id, count(*) as n from f where low group by user_id, island) select user_id, max(n) as longest from g group by 1""")  # fmt: skip
def longest_low_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("cents") < 2000
    a, b = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", low).orderBy("event_id")
    f = events(spark, sf_dir).select("user_id", low.alias("low"), (F.row_number().over(a) - F.row_number().over(b)).alias("island"))
    return f.filter("low").groupBy("user_id", "island").count().groupBy("user_id").agg(F.max("count").alias("longest"))


# Checks: each returns the rows that break a rule; over sound data they are counted.
_CHECKS = {
    "one_id_one_game": ("select p_partkey from part group by 1 having count(*) > 1", lambda t: t("part").groupBy("p_partkey").count().filter("count > 1")),
    "every_copy_has_an_entry": ("select l_orderkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey)", lambda t: t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")),
    "every_order_has_a_customer": ("select o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey)", lambda t: t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
    "no_empty_order": ("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)", lambda t: t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
    "copies_are_distinct": ("select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1", lambda t: t("lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")),
    "one_title_one_brand": ("select p_name, p_brand from part group by 1, 2 having count(distinct p_type) > 1", lambda t: t("part").groupBy("p_name", "p_brand").agg(F.countDistinct("p_type").alias("n")).filter("n > 1")),
    "shipped_after_order": ("select 1 from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate", lambda t: t("lineitem").join(t("orders"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate")))),
    "sizes_in_range": ("select p_partkey from part where p_size not between 1 and 50", lambda t: t("part").filter(~F.col("p_size").between(1, 50))),
    "no_blank_title": ("select p_partkey from part where trim(p_name) = ''", lambda t: t("part").filter(F.trim("p_name") == "")),
    "labels_have_documents": ("select doc_id from labels where not exists (select 1 from documents d where d.doc_id = labels.doc_id)", lambda t: t("labels").join(t("documents"), "doc_id", "left_anti")),
    "turns_have_no_gap": ("select conv_id from conversations group by 1 having max(turn) + 1 <> count(*)", lambda t: t("conversations").groupBy("conv_id").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n")).filter("m + 1 <> n")),
    "discount_in_range": ("select 1 from lineitem where l_discount > 0.1", lambda t: t("lineitem").filter("l_discount > 0.1")),
}


def _check(name: str, sql: str, rows):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(lambda t: table(spark, sf_dir, t)).agg(F.count(F.lit(1)).alias("violations"))

    run.__name__ = f"invariant_{name}"
    query(f"select count(*) as violations from ({sql})")(run)


for _name, (_sql, _rows) in _CHECKS.items():
    _check(_name, _sql, _rows)


@query("select k, c from (" + " union all ".join(f"select '{n}' as k, count(*) as c from ({s})" for n, (s, _) in _CHECKS.items()) + ")")
def invariant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in _CHECKS:
        one = QUERIES[f"invariant_{name}"](spark, sf_dir).select(F.lit(name).alias("k"), F.col("violations").alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with u as (select user_id as key, count(*) as total, count(*) filter (event_type = 'click') as input, count(*) filter (event_type = 'view') as output, sum({_CENTS})::bigint as cents, bool_or(event_type = 'error' and value > 97) as unpriced from events group by 1),
c as (select c_custkey as key, case when c_custkey % 5 > 0 then 60 + c_custkey % 40 end as total, case when c_custkey % 3 = 0 then 20 else 0 end as input, case when c_custkey % 4 = 0 then 20 end as output, case when c_custkey % 2 = 0 then 200000 + c_custkey * 100 end as cents from customer)
select 'user' as scope, key, case when c.total > 0 and coalesce(u.total, 0) >= c.total then 'total' when c.input > 0 and coalesce(u.input, 0) >= c.input then 'input' when c.output > 0 and coalesce(u.output, 0) >= c.output then 'output' when c.cents > 0 and key % 7 = 0 then 'unpriced call'
when c.cents > 0 and unpriced then 'unpriced usage' when c.cents > 0 and coalesce(u.cents, 0) >= c.cents then 'budget' end as hit from c left join u using (key)""")  # fmt: skip
def caps_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    u = events(spark, sf_dir).groupBy(F.lit("user").alias("scope"), F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("total"), count("click").alias("input"), count("view").alias("output"), F.sum("cents").alias("cents"), F.max((F.col("event_type") == "error") & (F.col("value") > 97)).alias("unpriced"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.lit("user").alias("scope"), k.alias("key"), F.when(k % 5 > 0, 60 + k % 40).alias("total"), F.when(k % 3 == 0, 20).otherwise(0).alias("input"), F.when(k % 4 == 0, 20).alias("output"), F.when(k % 2 == 0, 200000 + k * 100).alias("cents"))
    return R.enforced(u, c, c.filter("key % 7 = 0"))
