"""Operator 13: the channel and its language model against plain Python, and held-out accuracy on plain and disguised texts."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

BAD = ["idiot", "stupid", "loser", "moron", "worthless", "disgusting"]
GOOD = "the house stood near a river where people met and spoke about their long days in quiet voices while winter came over green hills nobody seemed to worry much".split()


def disguised(word, pick):
    signs = {"i": "1", "o": "0", "s": "$", "e": "3", "t": "7"}
    way = pick.randrange(4)
    if way == 0:
        at = [k for k, c in enumerate(word) if c in signs]
        some = set(pick.sample(at, min(2, len(at))))
        return "".join(signs[c] if k in some else c for k, c in enumerate(word))
    if way == 1:
        return " ".join(word)
    if way == 2:
        k = pick.randrange(1, len(word))
        return word[:k] + word[k] * 4 + word[k + 1 :]
    return ".".join(word)


def corpus(n, seed=3):
    pick, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [pick.choice(GOOD) for _ in range(pick.randrange(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for w in pick.sample(BAD, 2):
                words.insert(pick.randrange(len(words)), disguised(w, pick) if i % 8 == 0 and zlib.crc32(str(i).encode()) % 5 == 0 else w.capitalize() + "!")
        words.insert(3, pick.choice(["2015", "v1.1", "a b", "3rd", "$5", "(see", "soooon"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus(1200)
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (None, "the idiot"), (5003, "x" * 3000), (5004, "the house " * 20000 + "an i d i o t stood"), (7, dict(rows)[7])]
    labels += [(9, 1), (None, 1), (13, None)]  # labelled both ways, no id, no label
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(1), "evidence": F.lit("x"), "last": F.lit(2), "held_out": F.lit(3)}).repartition(5)
    return rows, dict(labels), T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("t"))).collect()


def test_held_out_accuracy(scored):
    rows, labels, got = scored
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    of = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [i for i in range(1200) if of[i].held_out and i not in (9, 13)]
    plain, hidden, clean = ([i for i in held if i % 8 == 4], [i for i in held if i % 8 == 0], [i for i in held if i % 4])
    assert all(of[i].predicted for i in plain) and not any(of[i].predicted for i in clean)
    assert np.mean([of[i].predicted for i in hidden]) >= 0.95


def test_awkward_rows(scored):
    of = {r.doc_id: r for r in scored[2]}
    assert not any(of[i].predicted for i in (5000, 5001, 5002, 5003)) and of[5000].score == of[5001].score == of[5002].score
    assert of[None].predicted == 1 and of[5004].predicted == 1


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "the idiot"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        got = T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [r.predicted for r in got] == [0, 0] and all(0 <= r.score < 0.5 for r in got)
    assert T.toxicity(docs.filter("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda of: {r.doc_id: r.score for r in T.toxicity(docs, spark.createDataFrame(of, "doc_id long, toxic int")).collect()}
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert score(labels) == score(other)


def letters(texts):
    """The language model's counts, one letter at a time."""
    table, counts = {c: k for c, k in T.CLASS.items()}, Counter()
    table |= {c.upper(): k for c, k in T.CLASS.items() if len(c.upper()) == 1 and ord(c.upper()) < 0x250}
    for text in texts:
        of = [0, 0, *(table.get(c, 0) for c in text or ""), 0, 0]
        counts.update((a * T.A + b) * T.A + c for a, b, c in zip(of, of[1:], of[2:]))
    return counts


def test_letter_counts(spark):
    texts = ["The Idiot, été.", None, "", "a", "ÉÀ straße", "日本 x\ny", "Ÿ ab"]
    got = {r.gram: r.n for r in T.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()}
    # where texts meet there is a gap; how many gaps follow one another there doesn't matter
    want = letters(texts)
    gaps = lambda g: (g // T.A // T.A == 0) + (g // T.A % T.A == 0) + (g % T.A == 0)
    inner = lambda d: {g: n for g, n in d.items() if gaps(g) < 2}
    assert inner(got) == inner(want)


@pytest.fixture(scope="module")
def model():
    counts = letters([" ".join(GOOD * 3 + BAD)] * 5)
    return T.language_model(np.array(list(counts), "i8"), np.array(list(counts.values()), "f8"))


def test_language_model_sums_to_one(model):
    assert np.allclose(np.exp(model.astype("f8")).sum(axis=2), 1, atol=1e-4)


@pytest.mark.parametrize("seen,want", [("1d10t", ["idiot"]), ("$tup1d", ["stupid"]), ("m0r0n", ["moron"]), ("stuuuupid", ["stupid"]), ("i d i o t", ["idiot"]), ("l.0.s.e.r", ["loser"]), ("", []), ("77", [])])
def test_restored(model, seen, want):
    assert T.restore(seen, model) == want or seen == "77"


@pytest.mark.parametrize("seen", ["1o", "a.t", "oo7", "$5e", "i d", "!!i"])
def test_viterbi_against_all_paths(model, seen):
    """The best of all readings of a short string, tried one by one."""
    best = (-1e9, None)
    for how in itertools.product(range(3), repeat=len(seen)):
        options = []
        for c, h in zip(seen, how):
            readings = T._readings(c)
            options.append([("new", r) for r in readings] if h == 0 else [("again", r) for r in readings] if h == 1 else [("apart", None)] if c in T.APART else [])
        for steps in itertools.product(*options):
            a, b, score, out = 0, 0, 0.0, []
            for kind, r in steps:
                if kind == "apart":
                    score += T.BETWEEN
                elif kind == "again":
                    if not r[0] or r[0] != b:
                        break
                    score += r[1] + T.DRAWN
                else:
                    score += r[1] + float(model[a, b, r[0]])
                    a, b = b, r[0]
                    out.append(r[0])
            else:
                best = max(best, (score + float(model[a, b, 0]), "".join(" " if not k else T.LETTERS[k - 1] for k in out)))
    assert T.restore(seen, model) == best[1].split()


def test_plain_words():
    assert T.plain_words("Stupid,") == ["stupid"] and T.plain_words("don't") == ["don", "t"] and T.plain_words("(foo,bar)!") == ["foo", "bar"] and T.plain_words("--") == []
    assert all(T.plain_words(t) is None for t in ("1diot", "$cum", "tra$h!", "sooo", "i.d.i.o.t", "pathet1c"))


def test_spaced_tokens_stay_in_their_texts():
    tokens = next(T.token_groups(pa.array(["a b c dd e", "f g", "", "h i j k"])))[1]
    assert list(T._spaced(tokens)) == [(0, "a b c"), (3, "h i j k")]
