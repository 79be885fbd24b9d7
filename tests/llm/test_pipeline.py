"""The pipeline against plain Python, stage by stage, on a small corpus with planted cases."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [text(rng.randrange(60, 300)) for _ in range(40)]
    near = [" ".join(w if k % 97 else "zz" for k, w in enumerate(t.split(), 1)) for t in clean[:8]]
    passage = text(70)
    shared = [text(80) + "\n" + passage + "\n" + text(80) for _ in range(6)]
    junk = ["## $$ %% " * 40, "short text", None, "", "same words here " * 60]
    rows = clean + near + clean[:5] + [t.upper() for t in clean[5:9]] + shared + junk
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def expected(rows):
    kept = {}
    for i, t, *_ in rows:  # quality
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        symbols, chars = len(re.findall("[#*$%&|<>]", t or "")), sum(map(len, words))
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and 10 * symbols <= chars:
            kept[i] = t
    last = {}
    for i in sorted(kept):  # exact copies
        last[kept[i].translate(UP)] = i
    kept = {i: kept[i] for i in sorted(last.values())}
    sets = {i: {tuple(w[k : k + 5]) for w in [WORD.findall(t.translate(UP))] for k in range(len(w) - 4)} for i, t in kept.items()}
    root = {i: i for i in kept}
    find = lambda x: x if root[x] == x else find(root[x])
    for x in kept:
        for y in kept:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    kept, seen, out = {i: kept[i] for i in kept if find(i) == i}, set(), {}
    for i in sorted(kept):  # repeated passages
        words, gone = WORD.findall(kept[i]), set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if w in seen else set()
            seen.add(w)
        out[i] = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else kept[i]
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    want = expected(rows)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert 40 <= len(want) < len(rows) - 10 and any(want[i] != rows[i][1] for i in want)
    tokenizer, ends = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.length > 0 and r.offset + r.length <= 1024
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, t in want.items():
        n, at = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1, 0
        for start, length, total in sorted(pieces[i]):
            assert (start, total) == (at, n)
            at += length
        assert at == n
    filled = np.array([sum(n for _, n in ends[k]) for k in range(len(ends))])
    assert (filled[:-1] == 1024).all()


def stages(spark, folder, rows):
    """What is left after all stages but packing, and the pieces that the whole run gives."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
    return docs.collect(), corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Rows without an id, several rows of one id, equal rows, and nulls in every other column: nothing crashes, and each clean text stays once."""
    rng = random.Random(3)
    clean = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(2000)}" for _ in range(120)) for _ in range(8)]
    rows = [(1, clean[0], "en", "s", 1), (1, clean[1], None, None, None), (2, clean[2], "en", "s", None), (2, clean[2], "en", "s", None), (None, clean[3], "en", None, 3), (None, clean[4], None, "s", 3), (None, None, None, None, None), (3, clean[3], "en", "s", 2), (4, "", "en", "s", 0), (5, clean[5].upper(), "de", "s", 9), (6, clean[5], "de", "s", 9), (7, clean[6], "fr", "s", 9)]
    left, pieces = stages(spark, tmp_path, rows)
    assert {r.text for r in left} == {clean[0], clean[1], clean[2], clean[3], clean[4], clean[5], clean[6]}
    assert {r.doc_id for r in left} == {1, 2, None, 3, 6, 7} and {r.doc_id for r in pieces} == {1, 2, None, 3, 6, 7}
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id == 7) > 0


def test_pipeline_of_nothing(spark, tmp_path):
    left, pieces = stages(spark, tmp_path, [])
    assert left == [] and pieces == []
