"""A patched catalog has the rows of one that is built anew, and reads only what decisions touch."""

import random

from pyspark.sql import functions as F

from tessera.operators import catalog, patch
from tessera.plans.patch import entries_of


def source_rows(spark, n=300, seed=5):
    pick = random.Random(seed)
    rows = [(f"game {pick.randrange(30)}", pick.choice(["pc", "snes"]), pick.choice("NRA"), str(pick.randrange(40)), f"Title {i}", pick.choice(["", "x", "y"]), pick.choice(["have", "want"]), i) for i in range(n)]
    return spark.createDataFrame(rows, "norm_key string, platform string, source string, source_id string, title string, detail string, state string, seq int")


def entries(df):
    return sorted(tuple(r) for r in df.select("norm_key", "platform", "title", "n_sources", "n_kinds", "sources_summary", "owned").collect())


def decisions(spark, merges, splits):
    return spark.createDataFrame(merges, "alias string, target string"), spark.createDataFrame(splits, "norm_key string, source string, source_id string, to string")


def test_patched_is_rebuilt(spark, tmp_path):
    rows = patch.store(source_rows(spark), str(tmp_path / "rows"))
    table = patch.store(entries_of(rows.drop("bucket")), str(tmp_path / "entries"))
    raw = source_rows(spark)
    some = [tuple(r) for r in raw.filter("norm_key = 'game 3'").select("norm_key", "source", "source_id").distinct().collect()]
    steps = [
        ([("game 1", "game 2"), ("game 2", "game 9"), ("unheard of", "game 4"), ("a", "b"), ("b", "a")], [(*some[0], "game 3 apart"), (*some[1], "game 5")]),
        ([("game 9", "game 0"), ("game 3 apart", "game 7")], [(*s, "game 8") for s in some[2:]]),
        ([], [("game 6", None, "1", "nowhere")]), ([], []),
    ]
    for k, (m, s) in enumerate(steps):
        merges, splits = decisions(spark, m, s)
        raw = patch.moved(raw, merges, splits)
        done = patch.patch(rows, merges, splits, entries_of)
        rows, table = patch.store(done.over(rows, done.rows), str(tmp_path / f"rows{k}")), patch.store(done.over(table, done.entries), str(tmp_path / f"entries{k}"))
        assert entries(table) == entries(entries_of(raw)), k
    assert not [r for r in entries(table) if r[0] in ("game 1", "game 2", "game 9", "game 3 apart")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    rows = patch.store(source_rows(spark), str(tmp_path / "rows"))
    done = patch.patch(rows, *decisions(spark, [("game 1", "game 2")], []), entries_of)
    buckets = {r[0] for r in spark.createDataFrame([("game 1",), ("game 2",)], "k string").select(patch.bucket_of(F.col("k"))).collect()}
    plan = done.entries._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("bucket IN", "bucket") and len(buckets) <= 2
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in {r[0] for r in rows.filter(F.col("bucket").isin(list(buckets))).select(F.input_file_name()).collect()}} <= buckets


def test_attributes_of_the_target_win(spark):
    attrs = spark.createDataFrame([("a", "pc", "genre", "x", "1"), ("b", "pc", "genre", "y", "2"), ("c", "pc", "maker", "m", "3"), ("a", "pc", "maker", "k", "4"), ("a", "pc", "maker", "l", "5"), ("d", None, "genre", "z", "6")], "norm_key string, platform string, kind string, value string, origin string")
    merges = spark.createDataFrame([("a", "b"), ("c", "b")], "alias string, target string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:4] for r in patch.folded_attributes(attrs, merges).collect())
    assert got == [("b", "genre", "y"), ("b", "maker", "k"), ("b", "maker", "l"), ("d", "genre", "z")]


def test_restamped(spark):
    media = spark.createDataFrame(
        [(1, "a", "", "igdb", "7", "title:a"), (2, "a", "", "igdb", "8", "igdb:8"), (3, "a", "", "other", "8", ""), (4, "a", "snes", "igdb", "8", "igdb:8"), (5, "b", "", "igdb", "", "igdb:1"), (6, "c", None, "x", None, None), (7, "d", "", "x", "", ""), (8, "e", "", "x", "", None)],
        "asset_id int, norm_key string, system string, provider string, meta string, game_key string",
    )
    entries = spark.createDataFrame([("a", "igdb:7"), ("a", "igdb:7"), ("b", "igdb:1"), ("b", "igdb:2"), ("c", None)], "norm_key string, game_key string")
    resolutions = spark.createDataFrame([("c", 5, False), ("d", 6, True)], "norm_key string, igdb_id int, bundle boolean")
    got = {r.asset_id: r.game_key for r in patch.restamped(media, entries, resolutions).collect()}
    assert got == {1: "igdb:7", 3: "igdb:7", 4: "igdb:8", 5: "igdb:1", 6: "igdb:5", 7: "title:d", 8: "title:e"}


def test_credited(spark):
    members = spark.createDataFrame([("c", "Ys II: Ancient Ys Vanished", "ys 2 ancient ys vanished", 0), ("c", "Sonic the Hedgehog 2", "sonic hedgehog 2", 0), ("c", "The Ultimate DOOM", "ultimate doom", 7), ("d", "Ys II: Ancient Ys Vanished", "ys 2 ancient ys vanished", None), ("c", ": odd", "odd", 0)], "coll_key string, member_title string, member_key string, member_id int")
    owned = spark.createDataFrame([(7, "doom"), (8, "ys 2 ancient ys vanished")], "identity_id int, base_key string")
    siblings = spark.createDataFrame([("c", "ys 2"), ("c", "sonic hedgehog")], "coll_key string, sibling string")
    got = [(r.coll_key, r.key, r.by) for r in patch.credited(members, owned, siblings).collect()]
    assert sorted(got) == [("c", "doom", "identity"), ("c", "odd", "self"), ("c", "sonic hedgehog 2", "self"), ("c", "ys 2", "sibling"), ("d", "ys 2 ancient ys vanished", "self")]


def test_purchase_siblings(spark):
    owned = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 2), ("d", 3), ("e", None)], "base_key string, product int")
    got = sorted((r.coll_key, r.sibling) for r in patch.purchase_siblings(spark.createDataFrame([("a",), ("e",), ("z",), ("a",)], "coll_key string"), owned).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c")]


def test_fold_has_no_third_exchange(spark):
    plan = catalog.fold_sources(source_rows(spark), ["N"])[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
