"""Operator 3 against plain Python."""

import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UP))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(rng):
    words = [f"w{k}" for k in range(400)]
    out = [None, "", " \n", "a", "A", "a b", "a  B", "b a", "a b c", "x " * 4000, "X " * 4000, "x " * 3999 + "y"]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 25)):  # a chain: every copy is of the one before, so ends may be unlike
            if rng.random() < 0.6:
                base = list(base)
                for _ in range(rng.randrange(1, 4)):
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base) if rng.random() < 0.8 else " ".join(base).upper())
    passage = " ".join(rng.choice(words) for _ in range(60))  # common to texts that are otherwise unlike
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    return out


@pytest.mark.parametrize("size, percent, seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3), (1, 50, 4)])
def test_against_brute_force(spark, size, percent, seed):
    rng = random.Random(seed)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(rng))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, label string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_rest_alone_finds_the_same(spark, monkeypatch):
    """Without rounds of leaders the exact rest finds every link by itself."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    rows = [(i, t) for i, t in enumerate(texts(random.Random(5)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame, 3, 70).collect()}
    assert got == brute(rows, 3, 70)


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_NODES", 4)
    monkeypatch.setattr(ngram_join, "SIDE_NODES", 3)
    monkeypatch.setattr(ngram_join, "ENDS", 2)


@pytest.mark.parametrize("size, percent, rounds, broadcast", [(3, 90, 4, "-1"), (5, 80, 1, "10m"), (2, 60, 1, "-1")])
def test_cut_groups(spark, small_groups, monkeypatch, size, percent, rounds, broadcast):
    """Groups of a token that are dealt to many tasks, and cut into blocks in the rest, lose no link."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(random.Random(size)))]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows, size, percent)


def test_very_long_texts(spark):
    """Near copies of 50,000 words, in two families that share a third of their words, and one text of a single long word."""
    rng = random.Random(6)
    common = [f"c{rng.randrange(10**6)}" for _ in range(17_000)]
    rows = []
    for family in range(2):
        base = common + [f"f{family}x{rng.randrange(10**6)}" for _ in range(33_000)]
        for k in range(3):
            own = list(base)
            for _ in range(200 * k):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**9)}"
            rows.append((family * 10 + k, " ".join(own)))
    rows.append((30, "x" * 400_000))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 10, 11: 10, 12: 10, 30: 30}


def test_nulls_empty_and_columns(spark):
    schema = "doc_id long, text string, n long"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (5, "a b c d e f", 2), (3, "A b c d e f", 3), (5, "a b c d e f", 2), (9, None, 4), (8, "", 5)], schema)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(rows).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 0, 8), (9, 0, 9)]
    kept = ngram_join.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id or -1, r.n) for r in kept.collect()) == [(-1, 1), (3, 3), (8, 5), (9, 4)]


def test_shingles_of_short_texts():
    (_, sizes, doc, values), = ngram_join.shingles([b"a b", b"a", b"", b"a b c", b"A B", b"b a"], 3)
    assert sizes.tolist() == [1, 1, 0, 1, 1, 1] and doc.tolist() == [0, 1, 3, 4, 5]
    assert values[0] == values[3] and len(np.unique(values)) == 4
