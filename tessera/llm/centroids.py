"""Plain Lloyd clustering over integer vectors, exact at any order of the rows.

Centroids are broadcast (k times `dims` integers, whatever the table's size). Each task finds the nearest
centroid of its vectors in NumPy and sums integers by cluster; a groupBy merges the tasks' sums, of which
the driver reads one number for each cluster and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import staged

#: Beyond this, squared differences may pass 64 bits; such vectors and centroids are computed with Python's integers.
NEAR = 1 << 27
LONG = (1 << 63) - 1
#: Sums travel in digits of this base, which decimals hold at any number of rows.
BASE = 10**18


@dataclass
class Clustering:
    """centroids: k lists of integers; assigned: (vec_id, cluster, distance), a row for each kept vector."""

    centroids: list[list[int]]
    assigned: DataFrame


def usable(table: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector has `dims` components, none of them null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == dims) & F.forall("vector", finite))


def _whole(values: np.ndarray, scale: int) -> list[int]:
    return [math.floor(Fraction(v) * scale) for v in values.tolist()]


def _quantised(vectors: pd.Series, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """floor(scale * x) of a batch as (rows, integers): 64-bit integers where they are small enough, else Python's."""
    x = np.stack(vectors.to_list())
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    near = (np.abs(scaled) <= NEAR).all(axis=1)
    if near.any():
        yield np.flatnonzero(near), scaled[near].astype("i8")
    if not near.all():
        yield np.flatnonzero(~near), np.array([_whole(v, scale) for v in x[~near]], dtype=object)


def _nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; of equally near centroids the first."""
    best, at = None, np.zeros(len(x), "i8")
    for k, c in enumerate(centroids):
        kind = object if x.dtype == object or max(map(abs, c)) > NEAR else "i8"
        off = x.astype(kind) - np.array(c, dtype=kind)
        distance = (off * off).sum(axis=1)
        if best is None:
            best = distance
            continue
        less = (distance < best).astype(bool)
        best, at[less] = np.where(less, distance, best), k
    return at, best


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in BASE, each digit with the integer's sign, so that digits can be summed by place."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest or not place:
        rest, digit = divmod(rest, BASE)
        yield place, sign * digit
        place += 1


def seeds(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; of equal ids the smaller vector first. Rows without an id are no seeds."""
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(name.alias("name"), "vector").orderBy("name", "vector").limit(k)
    return [_whole(np.array(r.vector), scale) for r in rows.collect()]


def _sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, their sums)}; a task sends its sums, never a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        counts, totals = [0] * len(own), [[0] * len(own[0]) for _ in own]
        for batch in batches:
            for _, x in _quantised(batch["vector"], scale) if len(batch) else ():
                at, _ = _nearest(x, own)
                for c in np.unique(at).tolist():
                    some = x[at == c]
                    counts[c] += len(some)
                    totals[c] = [a + b for a, b in zip(totals[c], some.sum(axis=0).tolist(), strict=True)]
        rows = [(c, d, place, digit) for c, n in enumerate(counts) if n for d, v in enumerate([n, *totals[c]]) for place, digit in _digits(v)]
        yield pd.DataFrame(rows, columns=["cluster", "component", "place", "total"])

    parts = vectors.select("vector").mapInPandas(run, "cluster int, component int, place int, total long")
    merged = parts.groupBy("cluster", "component", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    shared.unpersist()
    out = {}
    for r in merged:
        n = out.setdefault(r.cluster, [0] * (len(centroids[0]) + 1))
        n[r.component] += int(r.total) * BASE**r.place
    return {c: (n[0], n[1:]) for c, n in out.items()}


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a distance beyond 64 bits stands as the largest long."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cluster, distance = np.zeros(len(batch), "i4"), np.zeros(len(batch), "i8")
            for rows, x in _quantised(batch["vector"], scale):
                at, d = _nearest(x, shared.value)
                cluster[rows], distance[rows] = at, np.minimum(d, LONG).astype("i8")
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def lloyd(table: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Clusters the usable vectors of a table (see usable()) as integers floor(scale * x).

    Each round assigns every vector to its nearest centroid (squared Euclidean distance; ties: the smaller
    number) and moves each non-empty centroid to the componentwise floor of its vectors' mean; empty ones stay.

    Fewer than k usable vectors with an id: as many centroids. Null ids: clustered, but never seeds.
    Repeated rows count each by itself. None usable, or an empty table: no centroids and no rows.
    Components of any size are exact; only distances beyond 64 bits are cut to the largest long.
    """
    vectors = usable(table, dims, id_col, vector_col)
    centroids = seeds(vectors, k, scale, seed)
    if not centroids:
        return Clustering([], vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"))
    for _ in range(rounds):
        for c, (n, total) in _sums(vectors, centroids, scale).items():
            centroids[c] = [v // n for v in total]
    return Clustering(centroids, staged(assign(vectors, centroids, scale), "assigned"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def summary(spark: SparkSession, found: Clustering) -> DataFrame:
    """The assigned rows with what their clusters come to: a row for each of k clusters is all that is broadcast.

    cluster_inertia and inertia: distances summed over the cluster and over all, cut to the largest long.
    """
    capped: Column = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    of = {r.cluster: r.inertia for r in found.assigned.groupBy("cluster").agg(capped.alias("inertia")).collect()}
    rows = [(c, of.get(c, 0), min(LONG, sum(of.values())), digest(x)) for c, x in enumerate(found.centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
