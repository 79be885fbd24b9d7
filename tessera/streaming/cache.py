"""Answers that are kept for a time: what was found stays, a miss counts until its time to live is over.

State is held per key by the store, and an event-time timer ends a miss: it goes when the watermark
passes its end, whether or not its key is ever asked for again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .folds import run

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What becomes of a question.
FOUND, MISSED, HIT, FRESH_MISS, EXPIRED = "found", "missed", "hit", "fresh_miss", "expired"


def answers(ttl: int) -> StatefulProcessor:
    """The processor for a time to live in milliseconds. It is a class of this call, so that workers get it by value: not all of them can import this package."""

    class Answers(StatefulProcessor):
        """Rows (key, at in milliseconds, id or null where a search would find nothing) to rows (key, at, id, how).

        found or missed: the question is searched for; hit: a found id is given again; fresh_miss: a miss that
        still counts suppresses the search; expired: a miss ends, at its time to live. Within a batch a key's
        rows are taken in order of time (at one moment: found ids first), so that batches of any size give the
        same rows; a task holds one key's rows of one batch.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("answer", "id long, at long")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            kept = self.state.get() if self.state.exists() else None
            known, at = kept if kept else (None, None)
            before = at if known is None else None
            for row in sorted(rows, key=lambda r: (r.at, r.id is None, r.id or 0)):
                if known is None and at is not None and row.at >= at + ttl:
                    yield Row(key=key[0], at=at + ttl, id=None, how=EXPIRED)
                    at = None
                if known is not None:
                    yield Row(key=key[0], at=row.at, id=known, how=HIT)
                elif at is not None:
                    yield Row(key=key[0], at=row.at, id=None, how=FRESH_MISS)
                else:
                    known, at = row.id, row.at
                    yield Row(key=key[0], at=row.at, id=known, how=MISSED if known is None else FOUND)
            self.state.update((known, at))
            if before != (at if known is None else None):
                if before is not None:
                    self.handle.deleteTimer(before + ttl)
                if known is None:
                    self.handle.registerTimer(at + ttl)

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
            self.state.clear()
            yield Row(key=key[0], at=expiredTimerInfo.getExpiryTimeInMs(), id=None, how=EXPIRED)

        def close(self) -> None:
            pass

    return Answers()


def answered(asked: DataFrame, key: Column, at: Column, id: Column, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key string, at timestamp, id, how) of a stream of questions; see answers(). Null keys are one key, the empty string.

    Questions that come later than the watermark's delay are dropped. Needs the RocksDB state store: see served().
    """
    rows = asked.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), at.cast("timestamp").alias("time"), id.cast("long").alias("id")).filter("time is not null")
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    out = rows.groupBy("key").transformWithState(answers(ttl_ms), "key string, at long, id long, how string", "append", "EventTime")
    return out.select("key", F.timestamp_millis("at").alias("at"), "id", "how")


def served(stream: DataFrame) -> DataFrame:
    """All that answered() has for now, the store for its state being set for this query alone."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run(stream)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def progress(spark: SparkSession, stream: DataFrame, checkpoint: str, path: str) -> list[dict]:
    """Runs what is new through a query that goes on from its checkpoint, and gives its batches' figures (state rows among them)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()
        q.awaitTermination()
        return [{"rows": p.numInputRows, "state": sum(s.numRowsTotal for s in p.stateOperators), "watermark": p.eventTime.get("watermark")} for p in q.recentProgress]
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


