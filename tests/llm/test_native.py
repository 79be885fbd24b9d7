"""Operators 2, 5, 7, 8 and 10 against plain Python, on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, licenses, quality, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "la lo li " * 3000
ROWS = [
    (0, "One two three.\nOne two three.\n\n  \nfour"), (1, None), (2, ""), (3, " \t\n"), (4, "ONE two three.\nOne two three.\n\n  \nfour"),
    (5, "É é " * 30), (6, "é é " * 30), (7, LONG), (8, LONG.upper()), (9, "a b"), (10, "## $$ %% " * 20), (11, "one\ntwo\none\ntwo\ntwo"),
    (12, " ".join(f"w{i}" for i in range(60))), (13, "a b a b a b"), (14, "x x x x"), (15, "x y z\u0085 w"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that the operators name inside must not clash
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"row": F.lit("r"), "words": F.lit(1), "slot": F.lit(2), "failed": F.lit(3)})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_quality_measures(spark, docs):
    got = {r["row"]["doc_id"]: r for r in quality.ledger(docs).collect()}
    for i, text in ROWS:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, i
        assert bool(r.failed & quality.BIT["too_few_words"]) == (len(words) < 50)
    assert quality.ledger(empty(spark)).count() == 0


def test_quality_ablations_and_filter(spark, docs):
    book = quality.ledger(docs)
    masks = [r.failed for r in book.collect()]
    for r in quality.ablations(book).collect():
        bit, rest = quality.BIT[r.rule], quality.mask_of("v1") - quality.BIT[r.rule]
        assert r.documents == len(masks) and r.failed == sum(bool(m & bit) for m in masks)
        assert r.kept_without == sum(not m & rest for m in masks) and r.only_rule == sum(bool(m & bit) and not m & rest for m in masks)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {12}
    assert quality.keep_good(docs.filter("false")).count() == 0


def norm(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(params=["10m", "-1"])
def threshold(request, spark):
    """Joins are broadcast where they are small, and never."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_dedup(spark, docs, threshold):
    more = docs.unionByName(docs.filter("doc_id = 9")).unionByName(docs.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*ROWS, ROWS[9], (None, ROWS[12][1])]
    got = exact_dedup.exact_dedup(more).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    kept = exact_dedup.drop_copies(more)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() if k[3] for _ in range(n))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.drop_copies(empty(spark)).count() == 0


def test_ids_of_several_texts(spark, threshold):
    """Of rows of one id, each stays or goes as its own text does."""
    rows = spark.createDataFrame([(1, "A"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (None, "C"), (None, "d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(rows).collect()) == [(0, "d"), (1, "b"), (2, "a"), (3, "c"), (3, "c")]


def test_exact_dedup_moves_no_text(spark, docs, threshold):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    joins = exact_dedup.exact_dedup(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "text#" not in plan.replace("text_sha256", "") and ("SortMergeJoin" in joins) == (threshold == "-1")


def test_exact_dedup_hot_group(spark):
    """A group of more rows than a task takes is dealt to several, and comes back whole."""
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "Same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_dedup(rows).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, True, 10000), (20000, True, 1), (20000, False, 19999)}
    assert exact_dedup.drop_copies(rows).count() == 10001


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 1 << 32, (1 << 32) - 1, *range(1000, 1400), *(k * 2654435761 for k in range(100))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25):
        for r in rows.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect():
            assert r.s == jump(r.k, n), (r.k, n)


def test_shard(spark, docs):
    more = docs.unionByName(docs.filter("doc_id = 9")).unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard(more, 3).collect()
    assert len(got) == len(ROWS) + 2
    texts, slots = dict(ROWS) | {None: ""}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.law) == (len(raw) + 8, zlib.crc32(raw), jump(r.doc_id or 0, 3), "key")
        assert r.grown_shard in (r.shard, 3)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(empty(spark), 3).count() == 0


def test_urls(spark):
    urls = [
        None, "", "no-scheme/x", "http://A.Example.COM/en/7?x#y", "https://com/en/", "https://notcom/en/x", "http://x.example.com/en/71", "http://example.net/de/81", "http://b.net/de/8",
        "http://free-bets.xx/fr", "http://freebets.xx/free", "http://free.free.xx/free", "http://casino.xx/", "http://casinos.xx/", "ftp://h?://q/en/", "http://cheap.xx/?a=win", "x" * 50000 + "://free.win",
    ]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    said = [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(got.items())]
    assert said[:9] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("com", "/en/", "com/en/", "block"),
        ("notcom", "/en/x", None, "allow"), ("x.example.com", "/en/71", "example.com/en/7", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("b.net", "/de/8", "net/de/", "allow"),
    ]
    assert [x[3] for x in said[9:]] == ["block", "allow", "allow", "block", "allow", "allow", "block", "block"]
    assert said[14][:2] == ("h", "") and url_filter.judge(rows.filter("false")).count() == 0


def test_licenses(spark):
    texts = {
        1: "Text. Released under the MIT License. More", 2: "licensed  under the apache license, version 2.0", 3: None, 4: "", 5: "The MIT License is named here.",
        6: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        7: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. x. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        8: "word " * 30000 + ". All rights reserved!\nReleased under the MIT License.\nReleased under the MIT License.",
    }
    rows = spark.createDataFrame([(i, t, "p") for i, t in texts.items()], "doc_id long, text string, place string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: ["MIT"], 2: ["Apache-2.0"], 6: ["BSD-2-Clause"], 7: [], 8: ["MIT"]}
    assert got[8].n_sentences == 3 and got[8].sentence_ids == ["proprietary.all", "mit.released", "mit.released"]
    assert {r.doc_id: r.n_sentences for r in licenses.scan(rows.union(rows)).collect()} == {i: r.n_sentences for i, r in got.items()}
    assert licenses.scan(rows.filter("false")).count() == 0


def test_urls_of_other_columns_and_letters(spark):
    """Host and path come from the column that is given; letters that only become ASCII in lower case are no part of a term."""
    rows = spark.createDataFrame([("a://İx.DE/p?q", "b://other/"), ("no host", None), (None, "")], "link string, url string")
    got = [tuple(r) for r in rows.select(url_filter.host_of(F.col("link")), url_filter.path_of(F.col("link")), url_filter.host_of(F.col("url"))).collect()]
    assert got == [("İx.de", "/p", "other"), ("", "", ""), ("", "", "")]
    pages = spark.createDataFrame([(1, "x://Kasino/casıno"), (2, "x://h/CASINO"), (3, "İ casino"), (4, "x://bücher.de/win/prize")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == {1: "allow", 2: "block", 3: "block", 4: "block"}


def plain_jump(key, shards):
    """The published generator and loop of jump consistent hashing."""
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 12, 13, 24, 64, 65, 1000, 10000])
def test_jump_hash_of_many_shards(spark, shards):
    keys = [*range(300), -1, -(1 << 63), (1 << 63) - 1, 123456789012345]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: plain_jump(k, shards) for k in keys}
