"""The handle index and what ties finds together."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, index


def test_long_chains_and_circles_of_aliases(spark):
    """100,000 aliases, a chain of 5,000 among them, a circle and aliases that lead into it: a plan of one join a round."""
    rows = [(i, i + 1) for i in range(5000)] + [(10_000 + i, 9_000) for i in range(95_000)]
    circle = [(1_000_000, 1_000_001), (1_000_001, 1_000_002), (1_000_002, 1_000_000), (1_000_003, 1_000_000), (1_000_004, 1_000_003)]
    began = time.time()
    got = {r.alias: r.target for r in graphs.resolve_aliases(spark.createDataFrame(rows + circle, "alias long, target long")).collect()}
    assert time.time() - began < 60
    assert got == {i: 5000 for i in range(5000)} | {10_000 + i: 9_000 for i in range(95_000)}


def test_no_aliases(spark):
    assert graphs.resolve_aliases(spark.createDataFrame([], "alias long, target long")).count() == 0
    assert graphs.resolve_aliases(spark.createDataFrame([(1, 1)], "alias long, target long")).count() == 0


def plain_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for node, key in pairs:
        if node is not None and key is not None:
            a, b = find(("n", node)), find(("k", key))
            up[a] = b
    least = {}
    nodes = {n for n, k in pairs if n is not None and k is not None}
    for n in nodes:
        root = find(("n", n))
        least[root] = min(least.get(root, n), n)
    return {n: least[find(("n", n))] for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pick = random.Random(seed)
    pairs = [(pick.randrange(400), f"k{pick.randrange(500)}") for _ in range(500)] + [(n, "hub") for n in range(1000, 1400)] + [(n, f"c{n // 2 + d}") for n in range(2000, 2300) for d in (0, 1)]
    pairs += [(None, "hub"), (5000, None), (5001, "alone"), (1000, "hub")]
    got = {r.n: r.component for r in graphs.components(spark.createDataFrame(pairs, "n long, k string"), "n", "k").collect()}
    assert got == plain_components(pairs)
    assert graphs.components(spark.createDataFrame([], "n long, k string"), "n", "k").count() == 0


def test_components_deals_hot_keys(spark, monkeypatch):
    from tessera.operators import skew

    monkeypatch.setattr(skew.joined, "__defaults__", (10,))
    pairs = [(n, "hub") for n in range(200)] + [(n, f"x{n % 7}") for n in range(150, 300)]
    got = {r.n: r.component for r in graphs.components(spark.createDataFrame(pairs, "n long, k string"), "n", "k").collect()}
    assert got == plain_components(pairs)


def test_finds_that_share_a_key_are_one(spark):
    pairs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "b", "y"), (2, "c", "z"), (3, "c", "z"), (4, "d", "w"), (5, "a", "q"), (None, "a", "x"), (6, "a", None)], "find long, ns string, val string")
    known = spark.createDataFrame([("c", "z", 70), ("a", "x", 90), ("e", "e", 1)], "ns string, val string, identity_id long")
    got = {(r.find, r.ns): (r.identity_id, r.minted) for r in index.learn(pairs, known, 1000).collect()}
    assert got == {(1, "a"): (70, False), (1, "b"): (70, False), (2, "b"): (70, False), (2, "c"): (70, False), (3, "c"): (70, False), (4, "d"): (1004, True), (5, "a"): (1005, True)}


def test_a_key_stays_with_the_step_that_filed_it_first(spark):
    frame = lambda rows: spark.createDataFrame(rows, "ns string, val string, identity_id long")
    spine = frame([("igdb", "1", 1), ("igdb", "2", 2)])
    names = frame([("name", "doom", 1), ("name", "doom", 2), ("name", "", 1), ("name", None, 2)])
    later = frame([("name", "doom", 1), ("name", "doom", 3), ("igdb", "1", 9)]).withColumn("kind", F.lit("exact"))
    got = {(r.ns, r.val, r.identity_id): (r.step, r.kind) for r in index.build([index.Step("spine", spine), index.Step("names", names, index.DERIVED), index.Step("later", later, index.DERIVED)]).collect()}
    assert got == {
        ("igdb", "1", 1): ("spine", "exact"), ("igdb", "2", 2): ("spine", "exact"), ("name", "doom", 1): ("names", "derived"), ("name", "doom", 2): ("names", "derived"), ("name", "doom", 3): ("later", "exact"), ("igdb", "1", 9): ("later", "exact"),
    }


def test_a_record_takes_no_neighbour(spark):
    records = spark.createDataFrame([(1, "doom", "pc", 0.5), (2, "doom", "snes", 0.5), (3, "quake", "pc", 0.5), (4, None, "pc", 0.5), (5, "doom", "pc", 0.5), (6, "doom", None, 0.5)], "record_id long, key string, p string, w double")
    names = spark.createDataFrame([("name", "doom", 11), ("alias", "doom", 12), ("name", "hexen", 13), ("store", "quake", 14)], "ns string, val string, identity_id long")
    identities = spark.createDataFrame([(11, "pc", 0.2), (12, "pc", 0.2), (13, "pc", 0.9), (14, "pc", 0.9)], "identity_id long, ip string, iw double")
    gate = F.struct((F.col("iw") < F.col("w")).alias("ok"), F.col("iw").alias("score"))
    got = {r.record_id: (r.identity_id, r.kind) for r in index.merged(records, names, identities, gate, F.col("p").eqNullSafe(F.col("ip")), 100).collect()}
    assert got == {1: (11, "derived"), 5: (11, "derived"), 2: (102, "exact"), 3: (103, "exact"), 4: (104, "exact"), 6: (106, "exact")}
