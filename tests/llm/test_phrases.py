"""Operator 11 against plain Python, on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases as P

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def cut(text):
    return [WORD.findall(x) for x in PIECE.split(low(text))]


def brute(rows, support, longest=3, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in cut(text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= support}
        rest = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= inside * a for b in longer):
                rest.append((-score, -a, " ".join(p).encode("utf-8", "surrogatepass"), of[p[:k]], of[p[k:]]))
        out += [(lang, i, p.decode("utf-8", "surrogatepass"), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


def texts(seed, n, words=12):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "日本", "A", "a", "x\u0085y", " "]
    gaps = [" "] * 12 + ["\t", "  ", ", ", ".", "\n", "\r\n", " ; ", "\x0b", "\x0c", "!?"]
    return ["".join(pick.choice(vocabulary) + pick.choice(gaps) for _ in range(pick.randrange(40))) for _ in range(n)]


ROWS = [(k, t) for s, k in enumerate(["en", "de", None, "und"]) for t in texts(s, 40)] + [("en", None), ("en", ""), ("fr", " \t\n. ,"), ("en", "solo")] + [("xx", "hot word again " * 300)] + [("yy", "same same same same")] * 9


def frame(spark, rows):
    # columns that the operator names inside must not clash
    made = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id long, lang string, text string")
    return made.withColumns({"words": F.lit("v"), "stream": F.lit(1), "n": F.lit("d"), "phrase": F.lit(None).cast("string")}).repartition(3)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_against_plain_python(spark):
    assert got(P.collocations(frame(spark, ROWS), support=10)) == brute(ROWS, 10)


def test_first_of_each_language(spark):
    assert got(P.collocations(frame(spark, ROWS), support=3, top=7, inside_percent=90)) == brute(ROWS, 3, inside=90, top=7)


@pytest.mark.parametrize("longest", [2, 5])
def test_other_lengths(spark, longest):
    assert got(P.collocations(frame(spark, ROWS), support=4, longest=longest, stream_words=50)) == brute(ROWS, 4, longest)


def test_prefixes_in_parts(spark, monkeypatch):
    """Every prefix is cut in many parts and merged in several tasks before."""
    monkeypatch.setattr(P, "PREFIX_ROWS", 20)
    assert got(P.collocations(frame(spark, ROWS), support=5, stream_words=100)) == brute(ROWS, 5)


def test_nothing(spark):
    for rows in ([], [(None, None)], [("en", "one two three")]):
        df = P.collocations(frame(spark, rows) if rows else frame(spark, ROWS).filter("false"), support=10)
        assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.count() == 0


@pytest.mark.parametrize("segment,stream_words", [(7, 5), (64, 3), (64, 1000), (1 << 20, 10), (1, 1)])
def test_long_texts_are_cut_between_words(segment, stream_words):
    """A text in segments and streams has the words and phrases that it has as a whole."""
    rows = [("en", t) for t in texts(9, 6)] + [("de", "a b c d e f g, h " * 20 + "x" * 300 + " y z"), ("en", "x" * 500), ("de", None)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])
    found, counted = defaultdict(Counter), defaultdict(Counter)
    for b in P._streamed(iter([batch.slice(2), batch.slice(0, 2)]), 3, stream_words, segment, 0):
        words, codes, starts = b["words"][0].as_py(), np.frombuffer(b["codes"][0].as_py(), "<i4").tolist(), b["starts"][0].as_py()
        lang = b["lang"][0].as_py()
        counted[lang].update({w: c for w, c in zip(words, b["counts"][0].as_py(), strict=True) if c})
        for i in range(starts):
            for m in (1, 2, 3):
                some = codes[i : i + m]
                if len(some) == m and min(some) >= 0:
                    found[lang][tuple(words[c] for c in some)] += 1
    want, single = defaultdict(Counter), defaultdict(Counter)
    for lang, t in rows:
        for w in cut(t):
            single[lang].update(w)
            for m in (1, 2, 3):
                want[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v} and {k: v for k, v in counted.items() if v} == {k: v for k, v in single.items() if v}


def test_payloads_keep_large_counts():
    record = P._record(3, False)
    right, n = np.array([[1, 2], [1, 3]]), np.array([(1 << 32) * 3 + 5, 7])
    again = P._merged([P._payload(right, n, record)] * 2, record)
    assert again[0].tolist() == right.tolist() and again[1].tolist() == (2 * n).tolist()
