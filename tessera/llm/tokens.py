"""Token ids of whole texts through the tokenizers library, word by word.

Words are cut before a space that follows no white space, around a single line end, and between letters
and the marks behind them: no token and no look-ahead of a byte-level BPE's pattern crosses such a cut, so
a text's ids are its words' ids in a row. Each Python worker keeps the ids of the words it has met, within
bounds by number and length (beyond which it begins anew), and asks the library for new ones only.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text

#: Bare words and pieces, and words with marks or at the begin of a line, whose ids a worker keeps: about 200 bytes
#: each, as none of more than LONG characters is kept.
WORDS, FORMS, LONG = 1_200_000, 400_000, 100
#: Words that the library is asked for in one string, a line each.
LINES = 64
#: Rows of a slice; rows and characters that are encoded at a time (a longer text by itself).
SLICE, AT_ONCE, CHARACTERS = 256, 1024, 4 << 20
#: White space other than single spaces and line ends between words.
_OTHER = re.compile(r"[\t\r\v\f\0\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
#: Letters, and behind them marks; without the apostrophe, which begins tokens of its own kind.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
_CUT = re.compile(r"(?<=\S)(?= )")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Texts to ids, each text's as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, words: int = WORDS, forms: int = FORMS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.most_forms = Tokenizer.from_file(path), words, forms
        self.line_end = self._ids(["\n"])["\n"]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {" ": b""}  # by word; "\n" and a word for one that begins a line, " " and a word for one that begins the text
        self.forms: list[str] = []  # those of the known words that are put together from others
        self.pieces: dict[str, bytes] = {}  # of texts with white space in a row, by what stands between cuts
        self.marks: dict[str, bytes] = {"": b""}

    def _ids(self, strings: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(strings, found, strict=True)}

    def _bare(self, words: list[str]) -> None:
        """The ids of words without white space inside, several in a string: a line end is an id by itself, and in no word."""
        line_end = int.from_bytes(self.line_end, "little")
        rows = [words[k : k + LINES] for k in range(0, len(words), LINES)]
        strings = ["\n".join([w[1:] if w[:1] == " " else " " + w for w in row]) for row in rows]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = array("I", e.ids)
            raw, ends, at = ids.tobytes(), [4 * k for k, x in enumerate(ids) if x == line_end], 0
            if len(ends) != len(row) - 1:  # an added token of the tokenizer has taken a line end
                self.known |= {w: self._ids([s])[s] for w in row for s in [w[1:] if w[:1] == " " else " " + w]}
                continue
            for w, end in zip(row, [*ends, len(raw)], strict=True):
                self.known[w], at = raw[at:end], end + 4

    def _learn(self, new: set[str]) -> list[str]:
        """Puts words among the known; returns those too long to stay there."""
        whole, plan, tails, long = set(), [], set(), []
        for w in new:
            first, tail, lead = w[:1], "", b""
            begins = first == " " or first == "\n"
            body = w[1:] if begins else w
            if not body.isalpha() and (m := _MARKED.fullmatch(body)):
                body, tail = m.groups()
            bare = " " + body if begins else body
            if bare not in self.known:
                whole.add(bare)
            if first == "\n":
                lead = self.line_end
            if lead or tail:
                plan.append((w, lead, bare, tail))
                if tail not in self.marks:
                    tails.add(tail)
            if len(w) > LONG:
                long += [w, bare]
        self._bare(list(whole))
        self.marks |= self._ids(list(tails))
        for w, lead, bare, tail in plan:
            self.known[w] = lead + self.known[bare] + self.marks[tail]
        self.forms += [w for w, _, _, _ in plan if len(w) <= LONG]
        return long

    def _by_piece(self, text: str) -> bytes:
        cut = _CUT.split(text)
        fresh = self._ids([p for p in set(cut) if p not in self.pieces])
        out = b"".join([fresh[p] if p in fresh else self.pieces[p] for p in cut])
        self.pieces |= {p: x for p, x in fresh.items() if len(p) <= LONG}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out, begin, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size > CHARACTERS and k > begin:
                out += self._encode(texts[begin:k])
                begin, size = k, len(t)
        return out + self._encode(texts[begin:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) - len(self.forms) + len(self.pieces) + len(self.marks) > self.words:
            self._forget()
        if len(self.forms) > self.most_forms:
            for w in self.forms:
                del self.known[w]
            self.forms = []
        plain = [_plain(t) for t in texts]
        # a slice's words are told apart by Arrow: here each distinct one is looked up once
        cut = pc.split_pattern(pa.array([" " + t.replace("\n", "\0\n").replace(" ", "\0") for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), "\0")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = self._learn({w for w in distinct if w not in self.known})
        ids = pa.array(map(self.known.__getitem__, distinct), pa.large_binary(), size=len(distinct)).take(words.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))[cut.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        joined = (bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False))
        out = [next(joined) if p else self._by_piece(t) for t, p in zip(texts, plain, strict=True)]
        for w in long:
            self.known.pop(w, None)
        self.marks = self.marks if sum(map(len, self.marks)) < 1 << 20 else {"": b""}
        return out


def _plain(text: str) -> bool:
    """Whether words are parted by single spaces and line ends only."""
    return not (text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(r in text for r in _RUNS) or _OTHER.search(text))


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives back what the worker keeps for texts: tasks that encode none need its memory for other things."""
    _encoders.clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def narrow(ids: bytes) -> bytes:
    """Ids as 16-bit integers where all fit, else as they are; wide() tells them apart by the first byte."""
    a = np.frombuffer(ids, "<u4")
    return b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\4" + ids


def wide(stored: bytes) -> bytes:
    return np.frombuffer(stored, "<u2", offset=1).astype("<u4").tobytes() if stored[:1] == b"\2" else stored[1:]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (the task), start (ids of the task's rows before it), n and ids (narrow() bytes) of each row.

    Null text: as empty. Rows keep the order in which the task reads them.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages had in this worker
        part, before, own = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in slices(batches, AT_ONCE):
            ids = [x + end for x in own.encode([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], "i8")
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, "i8")), pa.array(starts), pa.array(n), pa.array([narrow(x) for x in ids], pa.binary())], ["doc_id", "part", "start", "n", "ids"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, part long, start long, n long, ids binary")
