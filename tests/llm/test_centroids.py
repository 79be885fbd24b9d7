"""Operator 12 against plain Python, on awkward rows."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids as C

NAN, INF = float("nan"), float("inf")
GOOD = [
    (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, [0.1, 0.2, 0.3]), (4, [-1.0, -1.0, -1.0]), (5, [-0.001, 0.0, 0.001]), (6, [3.0, 3.0, 3.0]), (6, [3.0, 3.0, 3.0]),
    (7, [3.0, 3.1, 3.2]), (8, [2.9, 3.0, 3.0]), (None, [0.1, 0.2, 0.25]), (9, [0.3, 0.2, 0.1]), (10, [-2.0, 2.0, -2.0]), (11, [-2.1, 2.0, -2.0]), (12, [0.0, -0.0, 0.0]),
]
BAD = [(20, None), (21, []), (22, [1.0, 2.0]), (23, [1.0, 2.0, 3.0, 4.0]), (24, [1.0, None, 2.0]), (25, [NAN, 0.0, 0.0]), (26, [0.0, INF, 0.0]), (27, [0.0, 0.0, -INF])]


def brute(rows, k, rounds, seed):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in final:
        inertia[n] += d
    cut = lambda x: min(x, C.LONG)
    capped = Counter()
    for _, d, n in final:
        capped[n] += cut(d)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, cut(d), cut(capped[n]), cut(sum(cut(v) for v in capped.values())), names[n]) for i, d, n in final)


def frame(spark, rows, kind="double"):
    # columns that the operator names inside must not clash
    made = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return made.withColumns({"vector": F.lit("v"), "cluster": F.lit(1), "distance": F.lit("d"), "name": F.lit(None).cast("string")}).repartition(3)


def run(spark, rows, k, rounds=3, kind="double"):
    return Counter(map(tuple, C.summary(spark, C.lloyd(frame(spark, rows, kind), k, rounds, 3, seed=2)).collect()))


@pytest.mark.parametrize("k", [1, 4, 40])
def test_against_plain_python(spark, k):
    assert run(spark, GOOD + BAD, k) == brute(GOOD, k, 3, 2)


def test_far_vectors_are_exact(spark):
    far = [(30, [1e30, -1e30, 0.5]), (31, [1e30, -1e30, 0.75]), (32, [3e9, 0.0, 0.0]), (33, [1.7e308, 1.7e308, -1.7e308]), (34, [-3.3e30, 1e12, 1.0])]
    assert run(spark, GOOD + far, 5) == brute(GOOD + far, 5, 3, 2)
    assert run(spark, far, 3, rounds=2) == brute(far, 3, 2, 2)


def test_no_rows(spark):
    for rows in ([], BAD, [(None, [1.0, 2.0, 3.0])]):
        got = C.summary(spark, C.lloyd(frame(spark, rows), 4, 2, 3, seed=2))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_floats_and_digits(spark):
    rows = [(i, [i * 0.1, -i * 0.01, float(i % 5)]) for i in range(200)]
    import numpy as np

    as_floats = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, 7, kind="float") == brute(as_floats, 7, 3, 2)
    for v in (0, 5, -5, C.BASE, -C.BASE * C.BASE - 7):
        assert sum(d * C.BASE**p for p, d in C._digits(v)) == v
