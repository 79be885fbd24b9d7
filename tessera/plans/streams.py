"""The streaming folds, run over the events that there are: the same rows as their batch forms give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.streaming import cache, folds

from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.source(spark, f"{sf_dir}/events.parquet")


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') as start, event_type, count(*) as n from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.run(folds.tumbling(_events(spark, sf_dir)), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("select event_id, user_id from events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(folds.first_seen(_events(spark, sf_dir), ["event_id"])).select("event_id", "user_id")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(event_id) filter (k = 1) as event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) group by 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(folds.upserted(_events(spark, sf_dir), ["user_id"], F.struct("ts", "event_id"), ["event_type", "event_id"]), "complete")


@query("""with g as (select user_id, event_type, ts, event_id, case when date_trunc('second', ts) - date_trunc('second', lag(ts) over w) > interval 5 day then 1 else 0 end as gap from events window w as (partition by user_id, event_type order by ts)),
s as (select *, sum(gap) over (partition by user_id, event_type order by ts rows unbounded preceding) as k from g) select user_id, event_type, count(*) filter (k = m) as calls, m::bigint as expired from (select *, max(k) over (partition by user_id, event_type) as m from s) group by all""")  # fmt: skip
def stream_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.run(folds.expiring(_events(spark, sf_dir), 5), "update")
    return rows


@query("select event_id, event_type from events where ts >= timestamp '2024-01-20 00:00:00'")
def incremental_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mark = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return folds.since(e, "ts", mark, "event_id").select("event_id", "event_type")


_TTL = 36 * 3600 * 1000


@query(f"""with recursive e as (select cast(user_id as varchar) || '/' || event_type as key, epoch_us(ts) // 1000 as t, case when value > 60 then event_id end as id, event_id from events),
o as (select *, row_number() over (partition by key order by t, event_id) as n from e),
w as (select o.key, o.n, o.t, o.id, (select min(p.n) from o p where p.key = o.key and p.t >= o.t + {_TTL}) as later from o),
chain as (select key, n, t, id, later from w where n = 1 union all select w.key, w.n, w.t, w.id, w.later from chain c join w on w.key = c.key and w.n = c.later where c.id is null),
f as (select key, min(n) as n, any_value(id) as id from chain where id is not null group by key),
q as (select o.key, o.t, case when c.n is not null then c.id when f.n < o.n then f.id end as id, case when c.n is not null then case when c.id is null then 'missed' else 'found' end when f.n < o.n then 'hit' else 'fresh_miss' end as how
  from o left join chain c on c.key = o.key and c.n = o.n left join f on f.key = o.key),
x as (select key, t + {_TTL} as t, null as id, 'expired' as how from chain where id is null and t + {_TTL} <= (select max(epoch_us(ts) // 1000) from events))
select key, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S.%g') as "at", id, how from (select * from q union all select * from x)""")  # fmt: skip
def stream_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by user and kind: hits, misses that still count and those that end, by timers."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    rows = cache.served(cache.answered(_events(spark, sf_dir), key, F.col("ts"), F.when(F.col("value") > 60, F.col("event_id")), _TTL))
    return rows.select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "id", "how")
