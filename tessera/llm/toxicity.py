"""Toxicity of texts whose words may be disguised.

A noisy channel: what was meant is letters and gaps under a character language model; what is read may
have letters written as digits or signs, drawn out, or spaced apart. A Viterbi search over the lattice
of a disguised word's readings restores the likeliest, and the restored words are scored.

The language model's counts are gathered from every document. Evidence for words and their beginnings is
counted over a bounded sample of the labelled documents (LABELLED), which is broadcast, so that no text moves.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .bytewords import SEGMENT, bytes_of, first_bytes, groups, segments, words_at
from .common import staged

# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "#": "h",
}
#: Signs that may stand between the letters of a word.
APART = " .-_*·"
#: The letters of the language model; every other character is a gap, number 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CLASS = {c: k for k, c in enumerate(LETTERS, 1)}
A = len(LETTERS) + 1
#: Log probabilities of the channel: a sign for a letter, the sign itself, a letter drawn out, a mark between letters, the mark itself.
AS_LETTER, AS_SIGN, DRAWN, BETWEEN, AS_MARK = -1.5, -6.0, -2.0, -1.0, -1.0
#: Labelled rows that a model learns from, features that it keeps, and the evidence (G squared) that each needs.
LABELLED, FEATURES, EVIDENCE = 50_000, 50_000, 20.0
FOLDS, HELD_OUT, LAST = 5, 0, 4
#: Words whose weights a Python worker keeps.
KNOWN = 300_000
#: Marks around a word, and a letter three times in a row.
AROUND = "\"'()[]{}<>.,;:!?-_*«»“”„…#|+"
_DRAWN = re.compile(f"([{LETTERS}])\\1\\1")
_PLAIN, _THRICE = r"^\p{L}*$", "|".join(c * 3 for c in LETTERS)
_GAP = np.zeros(256, bool)
_GAP[list(b" \t\n\x0b\x0c\r")] = True


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# --- the language model


def _classes() -> np.ndarray:
    """The letter of every code point below 0x250, in either case."""
    table = np.zeros(0x250, "i4")
    for c, k in CLASS.items():
        table[ord(c)] = k
        if len(c.upper()) == 1 and ord(c.upper()) < 0x250:
            table[ord(c.upper())] = k
    return table


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) for every three letters that follow one another in any text, gaps at both ends: A ** 3 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _classes(), np.zeros(A**3, "i8")
        for batch in batches:
            texts = batch.column(0)
            for i, j in groups(texts):
                data, begins = bytes_of(texts.slice(i, j - i))
                first = np.repeat(np.flatnonzero(first_bytes(data, begins)), 2)
                for part in segments(data, _GAP[data], SEGMENT) if len(data) > SEGMENT else (np.insert(data, first, 32),):
                    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
                    of = np.zeros(len(points) + 4, "i4")
                    small = points < len(table)
                    of[2:-2][small] = table[points[small]]
                    total += np.bincount((of[:-2] * A + of[1:-1]) * A + of[2:], minlength=A**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(total[grams])], ["gram", "n"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    return docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(third letter | two before it), smoothed by the shorter contexts."""
    counts = np.zeros(A**3)
    counts[grams] = n
    three = counts.reshape(A, A, A)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + A)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)).astype("f4")


# --- the channel


def _readings(c: str) -> list[tuple[int, float]]:
    """What may have been meant by a character, as (letter, log probability)."""
    if c in CLASS:
        return [(CLASS[c], 0.0)]
    if c in SIGNS:
        return [*((CLASS[x], AS_LETTER) for x in SIGNS[c]), (0, AS_SIGN)]
    return [(0, AS_MARK)]


def restore(seen: str, model: np.ndarray) -> list[str]:
    """The words that were likeliest meant by what is seen, by a Viterbi search whose states are the last two letters.

    Each character is a letter, a sign for one, the same letter once more, a mark between letters, or a gap.
    Time is linear in the length; a state is a pair of the few readings of two neighbours.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c in seen:
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def to(state: tuple[int, int], score: float, path: tuple | None, following=following) -> None:
            had = following.get(state)
            if had is None or score > had[0]:
                following[state] = (score, path)

        for (a, b), (score, path) in states.items():
            if c in APART:
                to((a, b), score + BETWEEN, path)
            for letter, p in _readings(c):
                if letter and letter == b:
                    to((a, b), score + p + DRAWN, path)
                to((b, letter), score + p + float(model[a, b, letter]), (letter, path))
        states = following
    best = max(((score + float(model[a, b, 0]), path) for (a, b), (score, path) in states.items()), key=lambda s: s[0])[1]
    letters = []
    while best is not None:
        letter, best = best
        letters.append(letter)
    return [w for w in "".join(" " if not k else LETTERS[k - 1] for k in reversed(letters)).split(" ") if w]


def plain_words(token: str) -> list[str] | None:
    """The words of a token that is plain: letters with marks around or between them. None where it may be disguised."""
    low = token.lower()
    if low.isalpha() and not _drawn(low):
        return [low]
    words = "".join(c if c.isalpha() else " " for c in low).split()
    if not words:
        return []
    # signs at the end are punctuation; any other sign beside letters may stand for one
    core = low.strip(AROUND)
    disguised = any(c in SIGNS for c in core) or _drawn(core) or (len(words) > 2 and all(len(w) == 1 for w in words))
    return None if disguised else words


def _drawn(word: str) -> bool:
    return _DRAWN.search(word) is not None


def token_words(token: str, model: np.ndarray) -> list[str]:
    """The words of a token, restored where it may be disguised."""
    words = plain_words(token)
    return restore(token.lower().strip("\"'()[]{}.,;:?-_*«»“”„…"), model) if words is None else words


def features(words: list[str]) -> list[str]:
    """Words of two letters and more, and their beginnings of three to six letters; of a very long word its ends."""
    out = []
    for w in words:
        if len(w) > 1:
            out.append(w if len(w) <= 40 else f"{w[:20]}…{w[-20:]}")
            out.extend(f"{w[:k]}-" for k in range(3, min(len(w) - 1, 6) + 1))
    return out


# --- texts as tokens


@dataclass
class Tokens:
    """Some texts: the distinct tokens, each occurrence's token and text, and how many texts there are."""

    distinct: pa.Array
    code: np.ndarray
    doc: np.ndarray
    docs: int

    def spelt(self) -> list[str]:
        return [t.decode("utf-8", "replace") for t in self.distinct.cast(pa.large_binary()).to_pylist()]


def _spaced(tokens: Tokens) -> Iterator[tuple[int, str]]:
    """(text, characters) of three and more tokens of one character in a row."""
    one = (pc.utf8_length(tokens.distinct).to_numpy(zero_copy_only=False) == 1)[tokens.code] if len(tokens.distinct) else np.zeros(0, bool)
    before = np.append(False, one[:-1] & (tokens.doc[1:] == tokens.doc[:-1])) if len(one) else one
    heads = np.flatnonzero(one & ~before)
    ends = np.flatnonzero(one & ~np.append((one & before)[1:], False))
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            yield int(tokens.doc[a]), " ".join(tokens.distinct.take(tokens.code[a : b + 1]).to_pylist())


def _tokens(data: np.ndarray, begins: np.ndarray) -> Tokens:
    words, starts = words_at(data, first_bytes(data, begins), _GAP)
    coded = words.dictionary_encode()
    docs = len(begins) - 1
    return Tokens(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(begins[1:], starts, "right"), docs)


def token_groups(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(place of the first text, tokens) of some texts at a time; a long one comes in parts, cut before a token that has a longer one before it."""
    for i, j in groups(texts):
        data, begins = bytes_of(texts.slice(i, j - i))
        if len(data) <= SEGMENT:
            yield i, _tokens(data, begins)
            continue
        gap = _GAP[data]
        cut = gap.copy()
        cut[1:] &= ~gap[:-1]
        cut[2:] &= ~gap[:-2]
        for part in segments(data, cut, SEGMENT):
            yield i, _tokens(part, np.array([0, len(part)]))


# --- learning


@dataclass
class Model:
    """letters: the language model; weights: log odds of features; bias and slopes: from what a text has of them to its score."""

    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    slopes: list[float] = field(default_factory=lambda: [0.0] * 4)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.starts = {f.removesuffix("-")[:3] for f in self.weights}


_known: dict[str, dict[str, float]] = {}


def _may_weigh(model: Model, tokens: pa.Array) -> np.ndarray:
    """The tokens that may be disguised or begin as a feature does; all others weigh nothing."""
    core = pc.utf8_trim(pc.utf8_lower(tokens), AROUND)
    plain = pc.and_not(pc.match_substring_regex(core, _PLAIN), pc.match_substring_regex(core, _THRICE))
    begins = pc.is_in(pc.utf8_slice_codeunits(core, 0, 3), pa.array(sorted(model.starts), core.type))
    return np.flatnonzero(pc.or_(pc.invert(plain), begins).to_numpy(zero_copy_only=False))


def token_weights(model: Model, tokens: pa.Array) -> np.ndarray:
    """The weight of each token: that of its strongest feature. A worker keeps the weights of some tokens between batches."""
    if len(_known.get(model.name, ())) > KNOWN or model.name not in _known:
        _known.clear()
        _known[model.name] = {}
    known, weights, out = _known[model.name], model.weights, np.zeros(len(tokens))
    some = _may_weigh(model, tokens)
    for k, t in zip(some.tolist(), tokens.take(some).to_pylist(), strict=True):
        w = known.get(t)
        if w is None:
            w = known[t] = max((weights.get(f, 0.0) for f in features(token_words(t, model.letters))), default=0.0)
        out[k] = w
    return out


def evidence(texts: pa.Array, model: Model) -> np.ndarray:
    """For each text its strongest weight, log(1 + sum of weights), log(1 + tokens that weigh) and their share."""
    top, total, hits, size = (np.zeros(len(texts)) for _ in range(4))
    for i, tokens in token_groups(texts):
        if not len(tokens.code):
            continue
        w = token_weights(model, tokens.distinct)[tokens.code]
        doc = tokens.doc + i
        np.maximum.at(top, doc, w)
        total += np.bincount(doc, w, len(texts))
        hits += np.bincount(doc, w > 0, len(texts))
        size += np.bincount(doc, minlength=len(texts))
        for d, seen in _spaced(tokens):
            w = max((model.weights.get(f, 0.0) for f in features(restore(seen.lower(), model.letters))), default=0.0)
            top[i + d], total[i + d], hits[i + d] = max(top[i + d], w), total[i + d] + w, hits[i + d] + (w > 0)
    return np.stack([top, np.log1p(total), np.log1p(hits), hits / np.maximum(size, 1)], axis=1)


def feature_counts(rows: DataFrame, letters: Broadcast) -> DataFrame:
    """(feature, pos, neg, pos_first, neg_first) of labelled rows (text, toxic, last): documents with it by label, in all folds and in those but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = letters.value, {}
        for batch in batches:
            label, last = (batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in (1, 2))
            kind = label + 2 * last
            for i, tokens in token_groups(batch.column(0)):
                if len(known) > KNOWN:
                    known = {}
                names: dict[str, int] = {}
                of = []
                for t in tokens.spelt():
                    if t not in known:
                        known[t] = features(token_words(t, model))
                    of.append([names.setdefault(f, len(names)) for f in known[t]])
                size, flat = np.array([len(x) for x in of], "i8"), np.array([f for x in of for f in x], "i8")
                begin = np.cumsum(size) - size
                pair = np.unique(tokens.doc * max(1, len(of)) + tokens.code) if len(of) else np.zeros(0, "i8")
                doc, code = np.divmod(pair, max(1, len(of)))
                n = size[code]
                at = np.repeat(begin[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                doc, feature = np.repeat(doc, n), flat[at]
                for d, seen in _spaced(tokens):
                    more = [names.setdefault(f, len(names)) for f in features(restore(seen.lower(), model))]
                    doc, feature = np.append(doc, [d] * len(more)).astype("i8"), np.append(feature, more).astype("i8")
                if not len(feature):
                    continue
                both = np.unique(feature * tokens.docs + doc)
                feature, doc = np.divmod(both, tokens.docs)
                counts = np.bincount(feature * 4 + kind[doc + i], minlength=4 * len(names)).reshape(-1, 4)
                columns = [counts[:, 1] + counts[:, 3], counts[:, 0] + counts[:, 2], counts[:, 1], counts[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(list(names)), *(pa.array(c) for c in columns)], ["feature", "pos", "neg", "pos_first", "neg_first"])

    parts = rows.select("text", "toxic", "last").mapInArrow(run, "feature string, pos long, neg long, pos_first long, neg_first long")
    return parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos_first", "neg_first")))


def strongest(counts: DataFrame, pos: str, neg: str, n_pos: int, n_neg: int, limit: int = FEATURES) -> dict[str, float]:
    """The log odds of the features for which toxic texts give most evidence; `limit` at most, which bounds the model."""
    if not n_pos or not n_neg:
        return {}
    p, n = F.col(pos).cast("double"), F.col(neg).cast("double")
    share = n_pos / (n_pos + n_neg)
    part = lambda x, rate: F.when(x > 0, x * F.log(x / ((p + n) * rate))).otherwise(0.0)
    rows = counts.select("feature", pos, neg, (2 * (part(p, share) + part(n, 1 - share))).alias("g")).filter((F.col("g") >= EVIDENCE) & (p / (p + n) > share))
    best = rows.orderBy(F.col("g").desc(), "feature").limit(limit).collect()
    return {r.feature: math.log((r[pos] + 0.5) / (n_pos + 1)) - math.log((r[neg] + 0.5) / (n_neg + 1)) for r in best}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Bias and slopes by Newton's steps, slopes held small by a ridge."""
    rows = np.column_stack([np.ones(len(x)), x])
    w, hold = np.zeros(rows.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + hold, rows.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), w[1:].tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from documents and their labels (0 or 1), of which the rows of fold 0 are never read.

    Ids labelled both ways, or of several rows, count as unlabelled. The language model takes every document. Features are
    counted on LABELLED rows at most, the first by a hash of their ids, of all learning folds; how scores
    follow from features is set on the last of these folds with features of the others.
    """
    spark = docs.sparkSession
    grams = letter_counts(docs, text_col).collect()  # A ** 3 rows at most
    letters = language_model(np.array([r.gram for r in grams], "i8"), np.array([r.n for r in grams], "f8"))
    shared = spark.sparkContext.broadcast(letters)
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # its size is bound, so that it is broadcast and no text moves
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    single = rows.select("doc_id").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("toxic").alias("toxic")).filter("rows = 1").drop("rows")
    rows = rows.join(F.broadcast(staged(single, "sample")), "doc_id")
    rows = staged(rows.withColumn("last", (fold(F.col("doc_id")) == LAST).cast("int")), "labelled")
    sizes = {(r.toxic, r.last): r.n for r in rows.groupBy("toxic", "last").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda toxic, *last: sum(sizes.get((toxic, k), 0) for k in last)
    counts = staged(feature_counts(rows, shared).filter("pos >= 3"), "features")
    held, fitted = rows.filter("last = 1"), Model(letters, strongest(counts, "pos_first", "neg_first", n(1, 0), n(0, 0)))
    if not fitted.weights or min(n(1, 1), n(0, 1)) < 5:
        held, fitted = rows, Model(letters, strongest(counts, "pos", "neg", n(1, 0, 1), n(0, 0, 1)))
    pairs = _evidence_rows(held, fitted, ["doc_id", "toxic"]).collect()  # five numbers for each of LABELLED rows at most
    model = Model(letters, strongest(counts, "pos", "neg", n(1, 0, 1), n(0, 0, 1)))
    pairs.sort(key=lambda r: (r.doc_id, r.evidence))
    y = np.array([r.toxic for r in pairs], "f8")
    if len(pairs) and model.weights and 0 < y.sum() < len(y):
        model.bias, model.slopes = _logistic(np.array([r.evidence for r in pairs]), y)
    shared.unpersist()
    return model


def _evidence_rows(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Rows with a text, as `keep` (long) columns and the text's evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = evidence(batch.column(0), own)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.tolist(), pa.list_(pa.float64()))], [*keep, "evidence"])

    return rows.select("text", *(F.col(c).cast("long") for c in keep)).mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", evidence array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Null or empty text: what a text without evidence gets. Null id: held out, and never learned from.
    Repeated rows: each by itself. Empty table: no rows. No labels to learn from, or of one kind only:
    no text has evidence and all scores are about 0.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = _evidence_rows(rows, model, ["doc_id"])
    linear = F.lit(model.bias)
    for k, slope in enumerate(model.slopes):
        linear = linear + F.lit(slope) * F.col("evidence")[k]
    p = (1 / (1 + F.exp(-linear))).alias("score")
    scored = found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(True)).alias("held_out"), p)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are labelled."""
    return score(docs, learn(docs, labels))
