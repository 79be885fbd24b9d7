"""Pairs found through the index are those that comparing all with all gives."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import gate
from tessera.functions.titles import norm
from tessera.operators import candidates as C

WORDS = ["doom", "quake", "star", "wars", "ii", "2", "iii", "3", "the", "x", "edition", "hd", "mega", "man", "megaman", "vii", "7", "1998", "of", "dark", "forces", "1", "i"]
GAPS = [" "] * 8 + [": ", " - "]


def titles(n, seed):
    pick, out = random.Random(seed), []
    for i in range(n):
        words = [pick.choice(WORDS) for _ in range(pick.randrange(0, 6))]
        out.append((i, pick.choice("ab"), "".join(w + pick.choice(GAPS) for w in words).strip()))
    return out + [(n, "a", None), (n + 1, "a", "Ys II: 3"), (n + 2, "a", "Ys: 3"), (n + 3, "a", "II: 3"), (n + 4, "a", "3"), (n + 5, "a", "III"), (n + 6, "a", "2: 3")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_accepted(spark, seed):
    rows = spark.createDataFrame(titles(150, seed), "id long, block string, title string")
    got = {r.a: (r.b, r.score) for r in C.best_accepted(rows, "id", ["block"], F.col("title")).collect()}
    a, b = rows.select(F.col("id").alias("a"), "block", gate.features(F.col("title")).alias("f")), rows.select(F.col("id").alias("b"), F.col("block").alias("other"), gate.features(F.col("title")).alias("g"))
    judged = a.join(b, (F.col("block") == F.col("other")) & (F.col("a") != F.col("b"))).select("a", "b", gate.judged_features(F.col("f"), F.col("g")).alias("j")).filter("j.ok")
    want = {}
    for r in judged.select("a", "b", "j.score").collect():
        want[r.a] = max(want.get(r.a, (-1.0, 0)), (r.score, -r.b))
    assert got == {k: (-v[1], v[0]) for k, v in want.items()} and len(got) > 50


@pytest.mark.parametrize("percent,piece", [(50, 1024), (70, 3), (100, 1024), (10, 2)])
def test_alike(spark, monkeypatch, percent, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = spark.createDataFrame(titles(200, 7), "id long, block string, title string")
    got = {(r.a, r.b, r.rows_a, r.rows_b, r.shared) for r in C.alike(rows, "id", ["block"], norm(F.col("title")), percent).collect()}
    keys = {}
    for r in rows.select("id", "block", norm(F.col("title")).alias("key")).collect():
        if r.key:
            keys.setdefault((r.block, r.key), []).append(r.id)
    want = set()
    for (p, x), ids in keys.items():
        for (q, y), others in keys.items():
            s, t = set(x.split()), set(y.split())
            if p == q and x < y and s & t and 100 * len(s & t) >= percent * len(s | t):
                want.add((min(ids), min(others), len(ids), len(others), len(s & t)))
    assert got == want


def test_no_titles(spark):
    none = spark.createDataFrame([], "id long, block string, title string")
    assert C.best_accepted(none, "id", ["block"], F.col("title")).count() == 0 and C.alike(none, "id", ["block"], norm(F.col("title")), 50).count() == 0


def test_what_meets_grows_with_the_titles(spark):
    """Titles of a common word and a rare one: twice the titles, twice the pairs formed, not four times."""

    def formed(n):
        rows = spark.createDataFrame([(i, "a", f"super w{i // 3}") for i in range(n)], "id long, block string, title string")
        kinds = C.kinds_of(rows, "id", ["block"], gate.features(F.col("title")))
        lists = C.postings(kinds, C.gate_tokens(F.col("f")))
        return C.meetings(C.gate_probes(kinds, lists), lists).count()

    small, large = formed(300), formed(1200)
    assert large <= 4.2 * small


@pytest.mark.parametrize("least,piece,members", [(2, 1024, 1024), (2, 3, 2), (1, 2, 3), (3, 1024, 1)])
def test_sharing(spark, monkeypatch, least, piece, members):
    """All rows of all keys that have so many words in common, however many more words they have."""
    monkeypatch.setattr(C, "PIECE", piece)
    monkeypatch.setattr(C, "MEMBERS", members)
    data = titles(200, 7) + [(1000, None, "Star Wars II"), (1001, None, "Star Wars"), (1002, "a", "Star Wars a b c d e f g h"), (1003, "a", "Star Wars k l m n o p q r")]
    rows = spark.createDataFrame(data, "id long, block string, title string")
    out = C.sharing(rows, "id", ["block"], norm(F.col("title")), least).collect()
    keys = [(r.id, r.block, r.key) for r in rows.select("id", "block", norm(F.col("title")).alias("key")).collect()]
    want = {(i, j): len(set(x.split()) & set(y.split())) for i, p, x in keys for j, q, y in keys if p is not None and p == q and x < y}
    want = {(*pair, n) for pair, n in want.items() if n >= least}
    assert {(r.a, r.b, r.shared) for r in out} == want and len(out) == len(want)
    assert least > 2 or (1002, 1003, 2) in want


def test_duplicate_candidates_are_of_any_length(spark, tmp_path):
    """Two words in common are enough, and each row of a key counts."""
    from tessera.plans.registry import QUERIES

    parts = [(0, "red bolt", "b", 1, "t"), (80, "red bolt", "b", 2, "t"), (5, "red bolt of many other words here", "b", 3, "t"), (85, "green bolt", "b", 3, "t"), (10, "red bolt x", "c", 3, "t")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in QUERIES["duplicate_candidates"](spark, str(tmp_path)).collect()}
    assert got == {(0, 5, 2), (80, 5, 2)}


@pytest.mark.parametrize("piece,members", [(1024, 1024), (3, 2)])
def test_judged_pairs(spark, monkeypatch, piece, members):
    """All with all of a block, accepted or refused, and each with itself."""
    monkeypatch.setattr(C, "PIECE", piece)
    monkeypatch.setattr(C, "MEMBERS", members)
    data = titles(120, 5) + [(1000, None, "Star Wars II"), (1001, None, "Star Wars"), (None, "a", "Star Wars")]
    rows = spark.createDataFrame(data, "id long, block string, title string")
    a, b = (rows.select(F.col("id").alias(n), F.col("block").alias(f"of_{n}"), gate.features(F.col("title")).alias(f"f_{n}")) for n in "ab")
    judged = a.join(b, F.col("of_a") == F.col("of_b")).select("a", "b", gate.judged_features(F.col("f_a"), F.col("f_b")).alias("j")).filter("j is not null")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = order(C.judged_pairs(rows, "id", ["block"], F.col("title")).collect())
    assert got == order(judged.select("a", "b", "j.ok", "j.score").collect())
    assert {ok for *_, ok, _ in got} == {True, False}


def test_gate_scores_has_refusals(spark, tmp_path):
    """Refused pairs, second-best ones and a title with itself are rows too."""
    from tessera.plans.registry import QUERIES

    parts = [(0, "red bolt", "b", 1, "t"), (80, "red bolt", "b", 1, "t"), (16, "green gear", "b", 1, "t"), (32, "red bolt", "b", 2, "t")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): (r.ok, r.score) for r in QUERIES["gate_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == {(x, y) for x in (0, 16, 80) for y in (0, 16, 80)} | {(32, 32)}
    assert got[0, 80] == got[16, 16] == (True, 2000000) and got[0, 16] == (False, 0)


@pytest.mark.parametrize("rows,members", [(4096, 1024), (7, 2)])
def test_judged_pairs_are_dealt(spark, monkeypatch, rows, members):
    """A few kinds of many rows make their pairs in several tasks, each pair once, with the score as it is shown."""
    monkeypatch.setattr(C, "ROWS", rows)
    monkeypatch.setattr(C, "MEMBERS", members)
    frame = spark.createDataFrame([(i, f"b{i % 8}", "Star Wars" if i % 16 < 8 else "Doom") for i in range(320)], "id long, block string, title string")
    judged = C.judged_pairs(frame, "id", ["block"], F.col("title"), lambda score: (score * 10).cast("int"))
    got = judged.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 8 * 40 * 40
    assert all(r.ok == (r.a % 16 == r.b % 16) and r.score == (20 if r.ok else 0) for r in got)
    assert len({r.task for r in got}) > 1


def test_gated_kinds_are_judged_once(spark):
    """Copies of rows don't form pairs: each owned row has the answer that comparing all with all gives, of judgments of titles alone."""
    from tessera.operators import identity as I

    data = [(i, b, t) for i, b, t in titles(150, 4) if t] + [(1000 + i, "a", t) for i in range(600) for t in ["Star Wars II" if i % 4 < 2 else "Star Wars"]] + [(5000, None, "Doom"), (5001, None, "Doom"), (5002, "b", "Doom"), (5003, "b", "Quake")]
    rows = spark.createDataFrame(data, "id long, block string, title string")
    owned, others = rows.filter("id % 2 = 0").withColumnRenamed("id", "a"), rows.filter("id % 2 = 1").withColumnRenamed("id", "b")
    seen = spark.sparkContext.accumulator(0)

    def counted(ok):
        seen.add(1)
        return ok

    count = F.udf(counted, "boolean")

    def judged(f, g):
        j = gate.judged_features(f, g)
        return F.when(j.isNotNull(), F.struct(count(j["ok"]).alias("ok"), j["score"].alias("score")))

    got = {r.a: (r.b, r.score) for r in I.gated_kinds(owned, others, "block", "title", gate.features, judged, "a", "b").collect()}
    featured = lambda of, n: of.select(F.col(n), "block", gate.features(F.col("title")).alias(f"f_{n}"))
    want = {r.a: (r.b, r.score) for r in I.gated(featured(owned, "a"), featured(others, "b"), "block", gate.judged_features(F.col("f_a"), F.col("f_b")), "a", "b").collect()}
    assert got == want and len(got) > 300 and 5000 not in got
    assert 0 < seen.value < 50_000
