"""Versions that are whole, and a walk that goes on where it was."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.snapshots import Conflict, Snapshots, pulled
from tessera.streaming.sweep import Sweep


def numbers(store, table="t", version=None):
    return sorted(r.n for r in store.read(table, version).collect())


def frame(spark, rows):
    return spark.createDataFrame([(n,) for n in rows], "n long")


def broken(spark):
    return spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("cut off")).cast("long")).otherwise(F.col("id")).alias("n"))


def test_readers_of_any_session_see_whole_versions(spark, tmp_path):
    mine, theirs = Snapshots(spark, str(tmp_path)), Snapshots(spark.newSession(), str(tmp_path))
    assert mine.current() is None
    with pytest.raises(LookupError):
        theirs.read("t")
    first = mine.publish({"t": frame(spark, [1, 2]), "u": frame(spark, [5])}, None)
    assert numbers(theirs) == [1, 2] and numbers(theirs, "u") == [5]
    with pytest.raises(Exception, match="cut off"):
        mine.publish({"u": frame(spark, [6]), "t": broken(spark)}, first)
    assert numbers(theirs) == [1, 2] and numbers(theirs, "u") == [5] and theirs.current() == first
    second = theirs.publish({"t": frame(spark, [3]), "u": frame(spark, [])}, first)
    assert numbers(mine) == [3] and numbers(mine, version=first) == [1, 2] and second.number == 2


def test_of_two_publishers_one_gets_through(spark, tmp_path):
    a, b = Snapshots(spark, str(tmp_path)), Snapshots(spark.newSession(), str(tmp_path))
    first = a.publish({"t": frame(spark, [1])}, None)
    b.publish({"t": frame(spark, [2])}, first)
    for expected in (first, None):
        with pytest.raises(Conflict):
            a.publish({"t": frame(spark, [9])}, expected)
    assert numbers(a) == [2] and len(list((tmp_path / "versions").iterdir())) == 2
    a.publish({"t": frame(spark, [3])}, a.current())
    a.keep(1)
    assert numbers(b) == [3] and len(list((tmp_path / "versions").iterdir())) == 1


def test_a_claim_that_was_never_named(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    first = store.publish({"t": frame(spark, [1])}, None)
    (tmp_path / "pointers" / ".2.claim").touch()
    with pytest.raises(Conflict):
        store.publish({"t": frame(spark, [2])}, first)
    store.freed()
    store.publish({"t": frame(spark, [2])}, first)
    assert numbers(store) == [2]


def test_a_pull_that_failed_or_shrank_keeps_the_list(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert pulled(store, "t", frame(spark, []))[1] == "shrank: 0 of 0" and store.current() is None
    assert pulled(store, "t", broken(spark))[1].startswith("failed") and store.current() is None
    assert pulled(store, "t", frame(spark, range(10)))[1] == "published"
    for rows, why in ((broken(spark), "failed"), (frame(spark, []), "shrank: 0 of 10"), (frame(spark, [1, 2]), "shrank: 2 of 10")):
        assert pulled(store, "t", rows)[1].startswith(why) and numbers(store) == list(range(10))
    assert pulled(store, "t", frame(spark, range(6)))[1] == "published" and numbers(store) == list(range(6))
    assert len(list((tmp_path / "versions").iterdir())) == 2


COLUMNS = "id long, v string"


class Source:
    """Rows with the time of their last change; some don't answer, and a page may kill the run."""

    def __init__(self, spark, n):
        self.spark, self.rows, self.silent, self.dies_at = spark, {i: ("old", 0) for i in range(1, n + 1)}, set(), None

    def ask(self, after, to, since):
        if self.dies_at is not None and after >= self.dies_at:
            raise KeyboardInterrupt
        rows = [(i, "timeout" if i in self.silent else None, v) for i, (v, at) in self.rows.items() if after < i <= to and at >= since]
        return self.spark.createDataFrame(rows, "id long, kind string, v string")


def rows_of(sweep):
    return {r.id: r.v for r in sweep.mirror().collect()}


def test_a_walk_that_was_killed_goes_on(spark, tmp_path):
    source = Source(spark, 20)
    whole = Sweep(spark, str(tmp_path / "whole"), COLUMNS)
    whole.run(source.ask, 20, 6, now=10)
    parts = Sweep(spark, str(tmp_path / "parts"), COLUMNS)
    source.dies_at = 12
    with pytest.raises(KeyboardInterrupt):
        parts.run(source.ask, 20, 6, now=10)
    state = Sweep(spark.newSession(), str(tmp_path / "parts"), COLUMNS).state()
    assert (state.cursor, state.pass_started, state.watermark) == (12, 10, 0) and sorted(rows_of(parts)) == list(range(1, 13))
    source.dies_at = None
    # a row behind the cursor changes between the two runs: the next pass must see it
    source.rows[3] = ("new", 15)
    again = Sweep(spark, str(tmp_path / "parts"), COLUMNS)
    assert again.run(source.ask, 20, 6, now=20).watermark == 10
    assert rows_of(again) == rows_of(whole) and rows_of(again)[3] == "old"
    again.run(source.ask, 20, 6, now=30)
    assert rows_of(again)[3] == "new" and again.state().watermark == 30 and again.state().cursor == 0


def test_gaps_are_asked_again(spark, tmp_path):
    source, sweep = Source(spark, 6), Sweep(spark, str(tmp_path), COLUMNS)
    source.silent = {2, 5}
    sweep.run(source.ask, 6, 3, now=10)
    assert sorted(rows_of(sweep)) == [1, 3, 4, 6]
    ledger = lambda: {r.id: (r.kind, r.first_seen, r.last_seen, r.tries) for r in sweep.gaps().collect()}
    assert ledger() == {2: ("timeout", 10, 10, 1), 5: ("timeout", 10, 10, 1)}
    source.silent = {5}
    sweep.commit(source.ask(0, 6, 0).join(sweep.gaps().select("id"), "id"), now=20)
    assert ledger() == {5: ("timeout", 10, 20, 2)} and sorted(rows_of(sweep)) == [1, 2, 3, 4, 6]


def test_the_backlog_is_drained_oldest_first(spark, tmp_path):
    sweep = Sweep(spark, str(tmp_path), COLUMNS)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    none = spark.createDataFrame([], "id long, kind string, v string")
    sweep.commit(none, 1, queued=keys("b", "c"))
    sweep.commit(none, 2, queued=keys("a", "b", "d"))
    assert [r.key for r in sweep.due(3).collect()] == ["b", "c", "a"] and [r.key for r in sweep.due(2, keys("d", "c", "z")).collect()] == ["c", "d"]
    sweep.commit(none, 3, ingested=sweep.due(2))
    assert [r.key for r in sweep.due(9).collect()] == ["a", "d"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sweep = Sweep(spark, str(tmp_path / "w"), COLUMNS)
    spark.createDataFrame([(1, None, "x"), (2, "timeout", None)], "id long, kind string, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, kind string, v string").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(sweep.each_batch(5)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    version = sweep.store.current()
    sweep.commit(spark.read.parquet(str(tmp_path / "in")), 6, batch=0)
    assert sweep.store.current() == version and rows_of(sweep) == {1: "x"} and sweep.gaps().first().tries == 1
