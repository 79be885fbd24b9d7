"""Substring dedup by fixed-block anchors.

Every text is a reference that is cut into blocks of half a window, one after another; the blocks are
indexed, and the rolling runs of all texts probe the index. Whatever window holds a run that hits a block
elsewhere is extended: it repeats another window exactly if and only if the windows on both sides have
one hash (80 bits), so hits are extended to maximal exact repeats by comparing the windows around them,
and no list of pairs is made. A window of 20 words always holds a whole block of 10 of the reference.

Texts are dealt once, to batches, and three passes go over that exchange: probes out, hits back and
windows out, repeats back. Between passes only packed lists of hashes and places move. A hash is sent
once from each batch, so a passage that thousands of texts share is as many rows as there are batches.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import hashing as H
from .common import batches_of, text_bytes

WINDOW = 20
#: Bits of a run's hash by which probes meet blocks. A chance meeting costs time only: windows decide.
PROBE_BITS = 48


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A batch in the order of ids, and that order; null texts as empty, null ids last."""
    ids = table.column("doc_id").fill_null(np.iinfo("i8").max).to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = table.column("text").to_pylist()
    return ids[order], [(texts[k] or "").encode() for k in order], order


def _each(ids: np.ndarray, texts: list[bytes]):
    """Slices of a batch: first document, first word, word hashes, words of each document."""
    word = 0
    for a, b in H.slices(texts):
        hashes, counts = H.words(texts[a:b])
        yield a, word, hashes, counts
        word += len(hashes)


def _by_part(values: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Bounds of equal ranges of hashes in a sorted row of them."""
    return np.searchsorted(values, (np.arange(1, parts, dtype="object") * (1 << bits) // parts).astype("u8"))


def _rows(batch: int, columns: dict[str, list]) -> pa.Table:
    n = len(columns["part"])
    return pa.table({"part": pa.array(columns["part"], pa.int32()), "batch": pa.array([batch] * n, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items() if k != "part"})


def _window_hashes(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that begin a window, and the two hashes of it (64 and 16 bits)."""
    places = np.flatnonzero(H.starts_within(counts, window))
    return places, H.runs(hashes, window)[places], H.runs(hashes, window, 1)[places] >> np.uint64(48)


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, and kept (the words left, joined by one space) of each row.

    A word goes if a window over it starts earlier too: in a row of a smaller id, or earlier in its own
    row. Null text: as empty, no words, kept is empty. Texts shorter than a window keep all. Null ids:
    after all others. Rows of one id: neither is earlier than the other at the same place. Empty table:
    no rows.
    """
    return _removed(docs.select(id_col, text_col), window, id_col, text_col, False).drop("rest")


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated words taken out of the texts, all columns kept; a text that loses none stays as it is."""
    rows = _removed(docs, window, id_col, text_col, True)
    return rows.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str, as_was: bool) -> DataFrame:
    """The rows of repeated_words, and the input row's other columns as `rest`. as_was: a text that loses nothing is `kept` as it was."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    batches = batches_of(docs.sparkSession, text_bytes(docs, text_col))
    parts = -(-batches // 4)
    shift = np.uint64(64 - PROBE_BITS)
    doc_id = docs[id_col].cast("long")
    dealt = docs.select(doc_id.alias("doc_id"), docs[text_col].alias("text"), F.struct(F.lit(0).alias("__"), *(docs[c] for c in docs.columns if c != text_col)).alias("rest"), F.pmod(F.xxhash64(doc_id), F.lit(batches)).cast("int").alias("batch"))

    def probe(table: pa.Table) -> pa.Table:
        """First pass: the batch's distinct runs; flag 1: it is a block, flag 2: it occurs twice or more here."""
        ids, texts, _ = _texts(table)
        found, flags = [], []
        for _, _, hashes, counts in _each(ids, texts):
            places = np.flatnonzero(H.starts_within(counts, block))
            first = np.repeat(np.cumsum(counts) - counts, counts)[places]
            found.append(H.runs(hashes, block)[places] >> shift)
            flags.append((places - first) % block == 0)
        values, flags = np.concatenate([np.zeros(0, "u8"), *found]), np.concatenate([np.zeros(0, bool), *flags])
        order = np.argsort(values, kind="stable")
        values, flags = values[order], flags[order]
        new = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0)
        blocks = np.add.reduceat(flags, new) > 0 if len(new) else flags
        many = np.diff(np.append(new, len(values))) > 1
        values = values[new]
        edges = [0, *_by_part(values, parts, PROBE_BITS), len(values)]
        out = {"part": [], "hashes": [], "flags": []}
        for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                out["part"].append(part), out["hashes"].append(H.pack_sorted(values[a:b]))
                out["flags"].append(H.pack(np.packbits(np.concatenate([blocks[a:b], many[a:b]]))))
        return _rows(table.column("batch")[0].as_py(), out)

    def meet(table: pa.Table) -> pa.Table:
        """The index of one range of hashes: which runs hit a block that is not just themselves, back to each batch."""
        batches, values, blocks, many = table.column("batch").to_pylist(), [], [], []
        for hashes, flags in zip(table.column("hashes").to_pylist(), table.column("flags").to_pylist(), strict=True):
            values.append(H.unpack_sorted(hashes))
            n = len(values[-1])
            bits = np.unpackbits(H.unpack(flags).astype("u1"), count=2 * n).astype(bool)
            blocks.append(bits[:n]), many.append(bits[n:])
        sizes = [len(v) for v in values]
        values, blocks, many = np.concatenate(values), np.concatenate(blocks), np.concatenate(many)
        order = np.argsort(values, kind="stable")
        new = np.flatnonzero(np.diff(values[order], prepend=~values[order][:1]) != 0)
        times = np.diff(np.append(new, len(values)))
        hit = (np.add.reduceat(blocks[order], new) > 0) & ((times > 1) | (np.add.reduceat(many[order], new) > 0))
        hits = np.zeros(len(values), bool)
        hits[order] = np.repeat(hit, times)
        out, at = [], 0
        for batch, n in zip(batches, sizes, strict=True):
            if hits[at : at + n].any():
                out.append((batch, H.pack_sorted(values[at : at + n][hits[at : at + n]])))
            at += n
        return pa.table({"batch": pa.array([x for x, _ in out], pa.int32()), "hits": pa.array([x for _, x in out], pa.binary())})

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        """Second pass: the windows that hold a hit, each once, with the first place in the batch."""
        out = {"part": [], "hashes": [], "more": [], "docs": [], "places": [], "at": []}
        if not table.num_rows or not found.num_rows:
            return _rows(0, out)
        ids, texts, _ = _texts(table)
        hits = np.sort(np.concatenate([H.unpack_sorted(x) for x in found.column("hits").to_pylist()]))
        got = []
        for a, word, hashes, counts in _each(ids, texts):
            inside = H.starts_within(counts, block)
            own = H.runs(hashes, block) >> shift
            at = np.minimum(np.searchsorted(hits, own), len(hits) - 1)
            sums = np.concatenate([[0], np.cumsum((hits[at] == own) & inside)])
            places, one, two = _window_hashes(hashes, counts, window)
            held = sums[places + window - block + 1] > sums[places]
            doc = np.repeat(np.arange(len(counts)), counts)
            places = places[held]
            first = (np.cumsum(counts) - counts)[doc[places]]
            got.append((one[held], two[held], ids[a + doc[places]].astype("u8"), (places - first).astype("u8"), (places + word).astype("u8")))
        one, two, doc, place, at = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((at, two, one))  # `at` ascends with doc_id and place
        one, two, doc, place, at = (x[order] for x in (one, two, doc, place, at))
        if len(one):
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            one, two, doc, place, at = (x[new] for x in (one, two, doc, place, at))
        edges = [0, *_by_part(one, parts, 64), len(one)]
        for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                out["part"].append(part), out["hashes"].append(H.pack_sorted(one[a:b]))
                for name, row in (("more", two), ("docs", doc), ("places", place), ("at", at)):
                    out[name].append(H.pack(row[a:b]))
        return _rows(table.column("batch")[0].as_py(), out)

    def compare(table: pa.Table) -> pa.Table:
        """The windows of one range of hashes: all but the earliest of equal ones go back to their batches."""
        batches = table.column("batch").to_pylist()
        columns = {"hashes": [H.unpack_sorted(x) for x in table.column("hashes").to_pylist()]}
        columns |= {name: [H.unpack(x) for x in table.column(name).to_pylist()] for name in ("more", "docs", "places", "at")}
        sizes = [len(x) for x in columns["hashes"]]
        one, two, doc, place, at = (np.concatenate(x) for x in columns.values())
        doc = doc.astype("i8")
        order = np.lexsort((place, doc, two, one))
        one, two, doc, place = (x[order] for x in (one, two, doc, place))
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each window, the earliest equal one
        later = np.zeros(len(one), bool)
        later[order] = (doc != doc[first]) | (place != place[first])
        out, k = [], 0
        for batch, n in zip(batches, sizes, strict=True):
            if later[k : k + n].any():
                out.append((batch, H.pack_sorted(np.sort(at[k : k + n][later[k : k + n]]))))
            k += n
        return pa.table({"batch": pa.array([x for x, _ in out], pa.int32()), "later": pa.array([x for _, x in out], pa.binary())})

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        """Third pass: repeats of other batches, and those within the batch, leave their words."""
        ids, texts, order = _texts(table)
        rest, none = table.column("rest").take(pa.array(order)), table.column("text").is_null().take(pa.array(order)).to_pylist()
        names, total, removed, kept = [], [], [], []
        if table.num_rows:
            later = np.concatenate([np.zeros(0, "u8"), *(H.unpack_sorted(x) for x in found.column("later").to_pylist())]).astype("i8")
            counts, places, one, two, word = [], [], [], [], 0
            for _, at, hashes, own in _each(ids, texts):
                p, x, y = _window_hashes(hashes, own, window)
                counts.append(own), places.append(p + at), one.append(x), two.append(y)
                word = at + len(hashes)
            counts, places, one, two = (np.concatenate(x) for x in (counts, places, one, two))
            by = np.lexsort((places, two, one))
            same = (one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1])
            firsts, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
            head = np.flatnonzero(np.concatenate([[True], ~same]))[np.cumsum(np.concatenate([[True], ~same])) - 1] if len(by) else by
            p, q = places[by], places[by][head]  # a window, and the first equal one in the batch
            apart = (ids[doc[p]] != ids[doc[q]]) | (p - firsts[doc[p]] != q - firsts[doc[q]]) if len(by) else np.zeros(0, bool)
            gone = np.zeros(word + 1, "i4")
            # only the first equal window of a batch came back: the others in its batch, of rows of one id too, are later as well
            starts = np.union1d(later, p[apart | np.isin(q, later)])
            np.add.at(gone, starts, 1), np.add.at(gone, starts + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            for k, t in enumerate(texts):
                own, mask = t.split(), keep[firsts[k] : firsts[k] + counts[k]]
                left = own if mask.all() else list(compress(own, mask.tolist()))
                total.append(len(own)), removed.append(len(own) - len(left))
                kept.append(b" ".join(left) if not (as_was and mask.all()) else None if none[k] else t)
            names = [None if i == np.iinfo("i8").max else int(i) for i in ids]
        return pa.table({"doc_id": pa.array(names, pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "rest": rest})

    by_batch = dealt.groupBy("batch")
    probes = by_batch.applyInArrow(probe, "part int, batch int, hashes binary, flags binary")
    hits = probes.groupBy("part").applyInArrow(meet, "batch int, hits binary")
    windows = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(extend, "part int, batch int, hashes binary, more binary, docs binary, places binary, at binary")
    later = windows.groupBy("part").applyInArrow(compare, "batch int, later binary")
    return by_batch.cogroup(later.groupBy("batch")).applyInArrow(remove, StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string").add(dealt.schema["rest"]))

