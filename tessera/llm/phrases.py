"""Phrase collocations by contiguous pattern growth.

Texts become streams of word codes, a stream for each language and some two million words, written once.
A word below the support can't be part of a phrase; the others get numbers, and each stream projects its
occurrences: for every frequent word (a prefix) the words to the right of its occurrences, as far as a
phrase can go, equal ones counted. A prefix's projections meet in one task, which extends it to the right
depth-first, each time among the occurrences of the phrase so far. Prefixes with very many occurrences
are cut by their next word, after their streams' projections were merged in several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bytewords import SEGMENT, bytes_of, first_bytes, groups, segments, words_at
from .common import staged
from .packing import task_offsets

#: Words of a stream.
STREAM_WORDS = 2_000_000
#: Bytes of words, or of projections, that a task holds before it writes or merges them.
HELD = 64 << 20
#: Occurrences of a prefix that one task takes.
PREFIX_ROWS = 1 << 20
# What ends a word, and what ends a piece too; letters that are lower-cased.
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
_LOW = np.arange(256, dtype="u1")
_LOW[65:91] += 32


def _cut(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, int]:
    """The lower-cased words of adjacent texts, the number of each word's piece (from 0), and how many pieces were begun."""
    first = first_bytes(data, begins)
    words, starts = words_at(_LOW[data], first, _GAP)
    pieces = np.cumsum(_BREAK[data] | first)
    return words, pieces[starts], int(pieces[-1]) if len(pieces) else 0


class _Streams:
    """A task's words by language, and their numbers of pieces, until they are written."""

    def __init__(self, longest: int, stream_words: int, task: int):
        self.longest, self.stream_words, self.task = longest, stream_words, task
        self.held, self.pieces, self.words, self.bytes, self.written = {}, 0, 0, 0, 0

    def add(self, lang: str, data: np.ndarray, begins: np.ndarray) -> None:
        words, pieces, begun = _cut(data, begins)
        self.held.setdefault(lang, []).append((words, pieces + self.pieces))
        self.pieces += begun
        self.words, self.bytes = self.words + len(words), self.bytes + len(data)

    def full(self) -> bool:
        return self.words >= self.stream_words or self.bytes >= HELD

    def flush(self, unfinished: str | None = None) -> Iterator[pa.RecordBatch]:
        """The streams held. Of a text that isn't at its end, the last words are the right of others here and begin phrases in the next stream."""
        held, self.held, self.words, self.bytes = self.held, {}, 0, 0
        for lang, parts in held.items():
            words, pieces = pa.concat_arrays([w for w, _ in parts]), np.concatenate([p for _, p in parts])
            n, tail = len(words), 0
            if lang == unfinished and n and pieces[-1] == self.pieces:
                tail = int((pieces[max(0, n - self.longest + 1) :] == pieces[-1]).sum())
                self.held[lang] = [(words.slice(n - tail), pieces[n - tail :])]
            if n == tail:
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("i4")
            breaks = np.flatnonzero(np.diff(pieces)) + 1
            stream = np.insert(codes, breaks, -1)
            counts = np.bincount(codes[: n - tail], minlength=len(coded.dictionary)).astype("i8")
            ends, name = np.array([0, len(counts)], "i4"), (self.task << 32) + self.written
            self.written += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([lang]), pa.ListArray.from_arrays(ends, coded.dictionary.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array([stream.astype("<i4").tobytes()]), pa.array([n - tail + len(breaks)])],
                ["stream", "lang", "words", "counts", "codes", "starts"],
            )


def _streamed(batches: Iterator[pa.RecordBatch], longest: int, stream_words: int, segment: int, task: int) -> Iterator[pa.RecordBatch]:
    """The streams of rows (lang, text)."""
    own = _Streams(longest, stream_words, task)
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, k))
            for i, j in groups(texts, segment):
                data, begins = bytes_of(texts.slice(i, j - i))
                if len(data) <= segment:
                    own.add(lang, data, begins)
                    if own.full():
                        yield from own.flush()
                    continue
                for n, part in enumerate(segments(data, _GAP[data], segment)):
                    own.add(lang, part, begins[: n == 0])
                    if own.full():
                        yield from own.flush(lang)
    yield from own.flush()


def streams(docs: DataFrame, longest: int, text_col: str = "text", lang_col: str = "lang", stream_words: int = STREAM_WORDS) -> DataFrame:
    """stream, lang, words (distinct), counts (of each), codes (places in words, -1 between pieces) and starts (codes that begin phrases)."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, longest, stream_words, SEGMENT, TaskContext.get().partitionId())

    return rows.mapInArrow(run, "stream long, lang string, words array<string>, counts array<long>, codes binary, starts long")


def frequent_words(made: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(words, totals) of streams: lang, word, id (from 1, without gaps) and f of each word with so many occurrences; lang and n of all occurrences."""
    counted = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    counted = staged(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n")).filter("n > 0")
    often = staged(counted.filter(F.col("f") >= support).select("lang", "word", "f", F.spark_partition_id().cast("long").alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at"), F.lit(1).alias("one")), "often")
    numbered = often.join(F.broadcast(task_offsets(often, "one")), "part").select("lang", "word", "f", (F.col("at") + F.col("offset") + 1).alias("id"))
    return numbered, totals


def _record(longest: int, wide: bool) -> np.dtype:
    """What stands to the right of an occurrence (numbers of words, 0 from where a phrase can't go on), and how often."""
    return np.dtype([("right", "<u8" if wide else "<u4", (longest - 1,)), ("n", "<u4")])


def _contexts(codes: np.ndarray, starts: int, longest: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows (word, words to its right) of occurrences of frequent words with a frequent word next, as codes from 1, and how often each is."""
    local = np.where(codes >= 0, np.where(often[codes], codes + 1, 0), 0).astype("i8")
    columns = [local[:starts]]
    for d in range(1, longest):
        right = np.zeros(starts, "i8")
        some = local[d : d + starts]
        right[: len(some)] = some
        columns.append(np.where(columns[-1] > 0, right, 0))
    goes_on = columns[1] > 0
    columns = [c[goes_on] for c in columns]
    bits = int(len(often)).bit_length()
    if bits * longest > 63:
        return np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    key = columns[0]
    for c in columns[1:]:
        key = (key << bits) | c
    key, counts = np.unique(key, return_counts=True)
    shifts = [bits * d for d in range(longest - 1, -1, -1)]
    return np.stack([(key >> s) & ((1 << bits) - 1) for s in shifts], axis=1) if len(key) else np.zeros((0, longest), "i8"), counts


def projections(made: DataFrame, words: DataFrame, longest: int, wide: bool) -> DataFrame:
    """prefix, part, salt, parts and payload (records) of each stream and frequent word. A prefix has a part for each PREFIX_ROWS occurrences."""
    parts = F.ceil(F.col("f") / F.lit(PREFIX_ROWS)).cast("int")
    asked = made.select("stream", "lang", F.posexplode("words").alias("code", "word"))
    known = asked.join(words.select("lang", "word", "id", parts.alias("parts")), ["lang", "word"]).select(F.col("stream").alias("of"), "code", "id", "parts")
    record = _record(longest, wide)

    def project(own: pa.Table, found: pa.Table) -> pa.Table:
        out = {"prefix": [], "part": [], "salt": [], "parts": [], "payload": []}
        if own.num_rows and found.num_rows:
            name, size = own.column("stream")[0].as_py(), own.column("size")[0].as_py()
            ids, split, often = np.zeros(size + 1, "i8"), np.ones(size + 1, "i4"), np.zeros(size, bool)
            code = found.column("code").to_numpy()
            ids[code + 1], split[code + 1], often[code] = found.column("id").to_numpy(), found.column("parts").to_numpy(), True
            rows, counts = _contexts(np.frombuffer(own.column("codes")[0].as_py(), "<i4"), own.column("starts")[0].as_py(), longest, often)
            records = np.zeros(len(rows), record)
            records["right"], records["n"] = ids[rows[:, 1:]], counts
            part = ids[rows[:, 1]] * 0x9E3779B1 % (1 << 32) * split[rows[:, 0]] >> 32
            order = np.lexsort((part, rows[:, 0])) if part.any() else np.arange(len(rows))
            word, part, records = rows[order, 0], part[order], records[order]
            heads = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(part) != 0))) if len(word) else np.zeros(0, "i8")
            offsets = np.append(heads, len(word)).astype("i4") * record.itemsize
            of = split[word[heads]]
            payload = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])
            out = {"prefix": ids[word[heads]], "part": part[heads].astype("i4"), "salt": (name * 0x9E3779B1 % (1 << 32) * of.astype("i8") >> 32).astype("i4"), "parts": of, "payload": payload}
        kinds = {"prefix": pa.int64(), "part": pa.int32(), "salt": pa.int32(), "parts": pa.int32(), "payload": pa.binary()}
        return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v, kinds[c]) for c, v in out.items()})

    left = made.select("stream", "codes", "starts", F.size("words").cast("long").alias("size")).groupBy("stream")
    return left.cogroup(known.groupBy("of")).applyInArrow(project, "prefix long, part int, salt int, parts int, payload binary")


def _merged(payloads: list[bytes], record: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The distinct right sides of some payloads, sorted, and how often each is."""
    rows = np.frombuffer(b"".join(payloads), record)
    right, n = rows["right"], rows["n"].astype("i8")
    order = np.lexsort(right.T[::-1])
    right, n = right[order], n[order]
    heads = np.flatnonzero(np.append(True, (right[1:] != right[:-1]).any(axis=1)))
    return right[heads], np.add.reduceat(n, heads)


def _payload(right: np.ndarray, n: np.ndarray, record: np.dtype) -> bytes:
    """Records of right sides; a count beyond a record's field stands in several."""
    top = np.iinfo("u4").max
    times = -(-n // top)
    rows = np.zeros(int(times.sum()), record)
    rows["right"] = np.repeat(right, times, axis=0)
    last = np.cumsum(times) - 1
    rows["n"] = top
    rows["n"][last] = n - (times - 1) * top
    return rows.tobytes()


def _by_key(batches: Iterator[pa.RecordBatch], keys: int, record: np.dtype) -> Iterator[tuple[tuple, list[bytes]]]:
    """The payloads of each key of sorted rows; what is held of one key is merged whenever it is much."""
    now, held, size = None, [], 0
    for batch in batches:
        *columns, payloads = (c.to_pylist() for c in batch.columns)
        for key, payload in zip(zip(*columns[:keys], strict=True), payloads, strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held, size = key, [], 0
            held.append(payload)
            size += len(payload)
            if size > HELD:
                held = [_payload(*_merged(held, record), record)]
                size = min(len(held[0]), HELD // 2)
    if held:
        yield now, held


def _grow(path: tuple[int, ...], counts: tuple[int, ...], right: np.ndarray, n: np.ndarray, support: int, found: Callable) -> None:
    """Extends a phrase by each word that stands often enough behind it, and each of those at once among its own occurrences.

    right: sorted words behind the phrase's occurrences; n: how often. found(phrase, how often its beginnings of two words and more are).
    """
    heads = np.flatnonzero(np.append(True, right[1:, 0] != right[:-1, 0]))
    totals, ends = np.add.reduceat(n, heads), np.append(heads[1:], len(right))
    for k in np.flatnonzero((totals >= support) & (right[heads, 0] > 0)).tolist():
        a, b = heads[k], ends[k]
        longer, often = (*path, int(right[a, 0])), (*counts, int(totals[k]))
        found(longer, often)
        if right.shape[1] > 1:
            a += np.searchsorted(right[a:b, 1], 1)  # of what is cut off here, nothing goes on
            if n[a:b].sum() >= support:
                _grow(longer, often, right[a:b, 1:], n[a:b], support, found)


def grown(projected: DataFrame, support: int, longest: int, wide: bool) -> DataFrame:
    """phrase (numbers of words) and counts (of its beginnings of two words and more, itself last) of each phrase with so many occurrences."""
    record = _record(longest, wide)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (prefix, part, _), payloads in _by_key(batches, 3, record):
            yield pa.RecordBatch.from_pydict({"prefix": [prefix], "part": pa.array([part], pa.int32()), "payload": [_payload(*_merged(payloads, record), record)]})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, counts = [], []

        def found(phrase: tuple[int, ...], often: tuple[int, ...]) -> None:
            phrases.append(phrase), counts.append(often)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"phrase": pa.array(phrases, pa.list_(pa.int64())), "counts": pa.array(counts, pa.list_(pa.int64()))})

        for (prefix, _), payloads in _by_key(batches, 2, record):
            _grow((prefix,), (), *_merged(payloads, record), support, found)
            if len(phrases) > 10000:
                yield out()
                phrases, counts = [], []
        if phrases:
            yield out()

    dealt = lambda rows, *keys: rows.repartition(*keys).sortWithinPartitions(*keys)
    split = dealt(projected.filter("parts > 1").select("prefix", "part", "salt", "payload"), "prefix", "part", "salt").mapInArrow(merge, "prefix long, part int, payload binary")
    rows = projected.filter("parts = 1").select("prefix", "part", "payload").unionByName(split)
    return dealt(rows, "prefix", "part").mapInArrow(grow, "phrase array<long>, counts array<long>")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", stream_words: int = STREAM_WORDS) -> DataFrame:
    """The best phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut to pieces at `[.,;:!?\\x0A-\\x0D]` and to words at spaces and tabs. A phrase
    with a >= support occurrences (overlapping ones too) is cut in two; the cut that gives the lowest
    floor(10^6 a a / (l r)), l and r being the occurrences of its parts, gives its score (ties: the shorter
    first part). A phrase inside a longer one with inside_percent of its occurrences or more goes.
    Ranks run by score, a (both descending) and phrase.

    Null text: no words. Null language: `und`. Empty table, or no frequent phrase: no rows. Repeated rows
    count each. Long texts are cut between words, and no phrase is lost there.
    """
    made = staged(streams(docs, longest, text_col, lang_col, stream_words), "streams")
    words, totals = frequent_words(made, support)
    words = staged(words, "numbered")
    wide = (words.agg(F.max("id").alias("id")).first().id or 0) >= 1 << 32
    projected = staged(projections(made, words, longest, wide), "projected", "lz4")
    found = staged(grown(projected, support, longest, wide), "phrases")
    a = F.element_at("counts", -1)
    phrases = found.select("phrase", "counts", a.alias("a"))
    # the occurrences of what a phrase ends with, and of what it begins with, are those of shorter phrases
    known = phrases.select(F.col("phrase").alias("rest"), F.col("a").alias("r")).unionByName(words.select(F.array("id").alias("rest"), F.col("f").alias("r")))
    firsts = words.select(F.col("id").alias("first"), F.col("f").alias("f_first"), "lang")
    started = phrases.withColumn("first", F.col("phrase")[0]).join(firsts, "first")
    cuts = started.select("lang", "phrase", "a", F.posexplode(F.concat(F.array("f_first"), F.slice("counts", 1, F.size("counts") - 1))).alias("k", "l"))
    cuts = cuts.withColumn("rest", F.expr("slice(phrase, k + 2, size(phrase) - k - 1)")).join(known, "rest")
    cuts = cuts.withColumn("score", F.expr("(cast(1000000 as decimal(8, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = phrases.filter("size(phrase) > 2").select(F.col("a").alias("longer"), F.expr("flatten(transform(sequence(2, size(phrase) - 1), m -> transform(sequence(1, size(phrase) - m + 1), i -> slice(phrase, i, m))))").alias("parts"))
    inner = inner.select(F.explode("parts").alias("phrase"), "longer").groupBy("phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, "phrase", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    # names are looked up only for what can be among the first
    order = [F.col("score").desc(), F.col("a").desc()]
    first = left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    spelt = first.select("phrase", F.posexplode("phrase").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = first.join(spelt, "phrase").withColumn("phrase", F.array_join("w.word", " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
