"""A walk over a source by ids that may stop at any time and goes on where it was.

What a page brings, the cursor, the ledger of ids that gave no answer and the backlog of keys are published
together, as one version: a run that dies between two pages has lost nothing and counts nothing twice.
The watermark moves only when a pass is at its end, and to the pass's start: rows are read again, never missed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.snapshots import Snapshots, Version

STATE = "cursor long, pass_started long, watermark long, batch long"
GAPS = "id long, kind string, first_seen long, last_seen long, tries long"
BACKLOG = "key string, queued_at long"
PAGES = "path string, number long"


@dataclass(frozen=True)
class State:
    """cursor: the last id of the pass so far (0: between passes); batch: the last micro-batch that was taken."""

    cursor: int = 0
    pass_started: int = 0
    watermark: int = 0
    batch: int = -1


class Sweep:
    """The walk's mirror, state, ledger and backlog below a folder. Answers are rows (id, kind, ...): a null kind is an answer, else it says why there is none."""

    def __init__(self, spark: SparkSession, root: str, columns: str):
        self.spark, self.store, self.columns = spark, Snapshots(spark, root), columns

    def _table(self, name: str, schema: str, version: Version | None) -> DataFrame:
        return self.store.read(name, version) if version else self.spark.createDataFrame([], schema)

    def state(self) -> State:
        version = self.store.current()
        return State(**self._table("state", STATE, version).first().asDict()) if version else State()

    def gaps(self) -> DataFrame:
        return self._table("gaps", GAPS, self.store.current())

    def backlog(self) -> DataFrame:
        return self._table("backlog", BACKLOG, self.store.current())

    def mirror(self) -> DataFrame:
        """The last answer for each id. Pages are written once and named by the version, never copied."""
        paths = [r.path for r in self._table("pages", PAGES, self.store.current()).collect()]  # a page holds as many rows as a run takes at a time
        if not paths:
            return self.spark.createDataFrame([], self.columns)
        names = self.spark.createDataFrame([], self.columns).columns
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy("id").agg(F.max_by(F.struct(*names), "_page").alias("r")).select("r.*")

    def commit(self, answers: DataFrame, now: int, queued: DataFrame | None = None, ingested: DataFrame | None = None, batch: int | None = None, **state: int) -> State:
        """Takes answers, and publishes all that follows from them at once.

        A batch that was taken before changes nothing. queued (key): new keys of the backlog, older ones keep their
        place; ingested (key): keys that were tried, whatever came of it.
        """
        version, before = self.store.current(), self.state()
        if batch is not None and batch <= before.batch:
            return before
        names = self.spark.createDataFrame([], self.columns).columns
        page, number = f"{self.store.root}/pages/{self.store.folder().rpartition('/')[2]}", (version.number if version else 0) + 1
        answers.withColumn("_page", F.lit(number)).write.parquet(page)
        taken = self.spark.read.parquet(page)
        answered = taken.filter("kind is null").select("id").distinct()
        failed = taken.filter("kind is not null").join(answered, "id", "left_anti").groupBy("id").agg(F.min("kind").alias("kind"))
        known = self._table("gaps", GAPS, version).join(answered, "id", "left_anti")
        seen = known.join(failed.withColumnRenamed("kind", "_kind"), "id", "full_outer")
        again = F.col("_kind").isNotNull()
        gaps = seen.select(
            "id", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("first_seen", F.lit(now)).cast("long").alias("first_seen"), F.when(again, F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"),
            (F.coalesce("tries", F.lit(0)) + again.cast("long")).alias("tries"),
        )
        backlog = self._table("backlog", BACKLOG, version)
        if queued is not None:
            backlog = backlog.unionByName(queued.select("key", F.lit(now).cast("long").alias("queued_at"))).groupBy("key").agg(F.min("queued_at").alias("queued_at"))
        if ingested is not None:
            backlog = backlog.join(ingested.select("key"), "key", "left_anti")
        rows = f"{page}-rows"
        taken.filter("kind is null").select(*names, "_page").write.parquet(rows)
        pages = self._table("pages", PAGES, version).unionByName(self.spark.createDataFrame([(rows, number)], PAGES))
        after = replace(before, **state) if batch is None else replace(before, batch=batch, **state)
        one = self.spark.createDataFrame([(after.cursor, after.pass_started, after.watermark, after.batch)], STATE)
        self.store.publish({"state": one, "gaps": gaps, "backlog": backlog.select("key", "queued_at"), "pages": pages.coalesce(1)}, version)
        return after

    def run(self, ask: Callable[[int, int, int], DataFrame], last: int, size: int, now: int, pages: int | None = None) -> State:
        """Walks on, `pages` pages at most. ask(after, to, since): the answers for ids after < id <= to that changed since then."""
        state, done = self.state(), 0
        while pages is None or done < pages:
            started = now if state.cursor == 0 else state.pass_started
            to = state.cursor + size
            answers = ask(state.cursor, to, state.watermark)
            if to >= last:
                return self.commit(answers, now, cursor=0, pass_started=started, watermark=started)
            state, done = self.commit(answers, now, cursor=to, pass_started=started), done + 1
        return state

    def due(self, limit: int, alive: DataFrame | None = None) -> DataFrame:
        """The oldest keys of the backlog; of those in `alive` (key) only, so that what is gone is never handed back."""
        rows = self.backlog()
        rows = rows.join(alive.select("key").distinct(), "key", "left_semi") if alive is not None else rows
        return rows.orderBy("queued_at", "key").limit(limit)

    def each_batch(self, now: int) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a stream's batches of answers, each once, however often it is replayed."""
        return lambda answers, batch: self.commit(answers, now, batch=batch) and None
