"""Operator 1 against plain Python."""

import random
import re

import numpy as np
import pytest

from tessera.llm import hashing, substring


def brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("window", [2, 3, 7, 20])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    base = [" ".join(rng.choice("ab cd é ef gh ij kl".split()) for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    texts = [None, "", " \n\t", "one", "x " * 5000, " ".join(map(str, range(12000))), " ".join(map(str, range(500, 9000)))]
    texts += [rng.choice([" ", "\n", "  \t"]).join(rng.choice(base).split()[rng.randrange(5) :]) + " " + rng.choice(base) for _ in range(60)] + base[:3] * 4
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, batch int, hits string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.repeated_words(frame, window).collect()}
    assert got == brute(rows, window)


def test_no_rows_nulls_and_equal_ids(spark):
    schema = "doc_id long, text string"
    assert substring.repeated_words(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(25)))
    rows = spark.createDataFrame([(None, text), (3, text), (3, text), (None, None), (2, "a b")], schema)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.repeated_words(rows).collect())
    assert got == [(-1, 0, 0), (-1, 25, 25), (2, 2, 0), (3, 25, 0), (3, 25, 0)]


def test_drop_repeats_keeps_columns(spark):
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(1, text, "x"), (2, "a\n b " + text, "y"), (3, "c  d", "z"), (4, None, "n")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in substring.drop_repeats(rows).collect()}
    assert substring.drop_repeats(rows).columns == rows.columns
    assert [(got[k].text, got[k].kept) for k in (1, 2, 3, 4)] == [(text, "x"), ("a b", "y"), ("c  d", "z"), (None, "n")]


def test_packed_rows():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, "u8"), np.array([0], "u8"), np.sort(rng.integers(0, 1 << 64, 1000, dtype="u8")), np.arange(300, dtype="u8")):
        assert (hashing.unpack_sorted(hashing.pack_sorted(values)) == values).all() and (hashing.unpack(hashing.pack(values)) == values).all()


@pytest.mark.parametrize("length", [1, 2, 3, 5, 10, 20])
def test_runs_tell_runs_apart(length):
    words = [b"a", b"b", b"ab", "é".encode(), b"ba"]
    rng = random.Random(length)
    texts = [b" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
    hashes, counts = hashing.words(texts)
    assert counts.tolist() == [50] * 20
    by, back = {}, {}
    for which in (0, 1):
        runs = hashing.runs(hashes, length, which)
        for place in np.flatnonzero(hashing.starts_within(counts, length)):
            key = b" ".join(texts[place // 50].split()[place % 50 : place % 50 + length])
            assert by.setdefault((which, key), runs[place]) == runs[place] and back.setdefault((which, runs[place]), key) == key


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8])
def test_rows_of_one_id_behind_an_earlier_document(spark, parts):
    text = " ".join(map(str, range(25)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for first in range(3):
            rows = spark.createDataFrame([(first, text), (5, text), (5, text), (5, text), (None, text), (None, text), (5, "x " + text)], "doc_id long, text string")
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.repeated_words(rows).collect())
            assert got == [(-1, 25, 25, "")] * 2 + [(first, 25, 0, text)] + [(5, 25, 25, "")] * 3 + [(5, 26, 25, "x")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
