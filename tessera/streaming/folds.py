"""The library's folds over streams: the same results as over tables, as rows come in.

Each function takes a streaming DataFrame and returns one, or starts a query on one; run() drives a
query through what there is and stops, with its progress in a checkpoint, so that a restart goes on
where it ended and never counts a row twice.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    """A new folder for checkpoints and results below spark.checkpoint.dir; only a local session may leave that unset."""
    kept = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="spark-")
    return f"{kept.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, some at a time; the table is a folder, or one file."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a plain path must be a folder, a pattern need not
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream has for now, through an exactly-once file sink; complete results through a batch sink."""
    spark, root = stream.sparkSession, shared_dir(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{root}/rows").start()
    else:
        q = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/rows")).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events by window and type.

    In append mode a window comes out once, when the watermark has passed its end; later rows for it are dropped and
    its state goes. In complete mode every window stays in the state and no row is dropped.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Replayed rows dropped: each key once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def upserted(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The latest row of each key so far (complete or update mode)."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*keys, "_last.*")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Drives a function that merges each batch into a table by key, which makes a replayed batch harmless."""
    root = shared_dir(stream.sparkSession)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()


def expiring(events: DataFrame, days: int) -> DataFrame:
    """(user_id, event_type, calls, expired): calls since the last silence of so many days, by state of three numbers a key.

    A silence is noticed at the next event of its key: there is no timer, and keys that never come again keep their state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, last, expired = state.get if state.exists else (0, 0, 0)
        times = sorted(int(t.timestamp()) for f in frames for t in f["at"])
        for t in times:
            if calls and t - last > days * 86400:
                calls, expired = 0, expired + 1
            calls, last = calls + 1, max(last, t)
        state.update((calls, last, expired))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "calls": [calls], "expired": [expired]})

    timed = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(step, "user_id long, event_type string, calls long, expired long", "calls long, last long, expired long", "update", GroupStateTimeout.NoTimeout)


def since(rows: DataFrame, column: str, watermark, key: str) -> DataFrame:
    """An incremental sweep in batch form: what has changed since the start of the last complete pass; overlaps, never a gap."""
    return rows.filter(F.col(column) >= F.lit(watermark)).orderBy(key)
