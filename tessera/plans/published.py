"""Queries over published versions and over a walk that was stopped and went on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources import learned
from tessera.sources.snapshots import Snapshots, pulled
from tessera.sources.staging import shared_dir
from tessera.sources.tables import table
from tessera.streaming.sweep import Sweep

from .registry import query


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 0")
def snapshot_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pulls and one that shrank, read by another session: the last whole list."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    root = _root(spark, "list")
    store = Snapshots(spark, root)
    for part in (rows.filter("c_acctbal > 500"), rows.filter("c_acctbal > 0"), rows.filter("c_acctbal > 9900")):
        pulled(store, "list", part)
    return Snapshots(spark.newSession(), root).read("list")


def _walked(spark: SparkSession, sf_dir: str) -> Sweep:
    """Events by id: the first walk stops after two pages and another goes on; then the ids without an answer are asked again."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    fails = (F.col("event_type") == "error") & (F.col("id") % 3 == 0)
    answers = events.select("id", F.when(fails, "timeout").alias("kind"), "user_id", "event_type")
    last = events.agg(F.max("id").alias("n")).first().n or 0
    ask = lambda after, to, since: answers.filter((F.col("id") > after) & (F.col("id") <= to))
    root, size = _root(spark, "walk"), last // 4 + 1
    sweep = Sweep(spark, root, "id long, user_id long, event_type string")
    sweep.run(ask, last, size, now=1000, pages=2)
    sweep = Sweep(spark, root, "id long, user_id long, event_type string")
    sweep.run(ask, last, size, now=2000)
    # of the ids in the ledger every other one answers the second time
    again = events.join(sweep.gaps().select("id"), "id").select("id", F.when(F.col("id") % 2 == 0, "timeout").alias("kind"), "user_id", "event_type")
    sweep.commit(again, 3000)
    return sweep


@query("select event_id as id, user_id, event_type from events where event_id > 0 and not (event_type = 'error' and event_id % 3 = 0 and event_id % 2 = 0)")
def resumable_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).mirror()


@query("select event_id as id, 'timeout' as kind, case when event_id <= 2 * (m // 4 + 1) then 1000::bigint else 2000 end as first_seen, 3000::bigint as last_seen, 2::bigint as tries from events, (select max(event_id) as m from events) where event_id > 0 and event_type = 'error' and event_id % 6 = 0")
def sweep_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).gaps()


@query("""with there as (select 'cust' as ns, cast(c_custkey as varchar) as val, c_custkey as identity_id from customer where c_custkey % 3 > 0), new as (select 'cust' as ns, cast(c_custkey as varchar) as val, c_custkey + 5000000 as identity_id from customer where c_custkey % 2 = 0)
select 'keys' as kind, ns, val, identity_id from there union all select 'keys', * from new where val not in (select val from there) union all select 'overrides', * from new union all select 'overrides', * from there where val not in (select val from new)""")  # fmt: skip
def learned_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and overrides of two installations, one taken into the other through JSON."""
    c = table(spark, sf_dir, "customer")
    rows = lambda where, more: c.filter(where).select(F.lit("cust").alias("ns"), F.col("c_custkey").cast("string").alias("val"), (F.col("c_custkey") + more).alias("identity_id"))
    there, new = rows("c_custkey % 3 > 0", 0), rows("c_custkey % 2 = 0", 5_000_000)
    of = lambda t: {"identities": t.select(F.col("identity_id").alias("id")), "keys": t, "overrides": t}
    path = _root(spark, "learned")
    learned.exported(of(new), path)
    out = learned.imported(spark, path, of(there))
    return out["keys"].withColumn("kind", F.lit("keys")).unionByName(out["overrides"].withColumn("kind", F.lit("overrides"))).select("kind", "ns", "val", "identity_id")
