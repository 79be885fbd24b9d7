"""N-gram Jaccard join with prefixes under several token orders.

Two sets of shingles that are similar enough share a token among the first few of each under any order of
all tokens. Three orders are used: by document frequency (rare first), which proposes candidates, and two
by hash. A pair is verified only if its prefixes meet, often enough, under all three.

Shingles are counted over packed lists between batches of texts, as are the frequencies that go back.
Equal sets are one node from the start. Links are found in rounds: in each group of nodes that share a
prefix token, a node is compared with the group's leader as long as both are in different components,
and the leader changes from round to round. What then is still apart, though it shares a prefix token, is
compared pair by pair, so that no link between components is lost and no group's pairs are all made.

A token's frequency tells how many tasks its group is dealt to. Intermediate tables are written to the
shared folder and emptied when what follows is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing as H
from .common import batches_of, cleared, id_text, staged, with_group
from .tokens import slices

#: Bits of a shingle's hash by which it is counted, and by which sets are compared.
COUNT_BITS, SET_BITS = 48, 56
#: Leaders that a node is compared with in a round; rounds at most, and the share of the best round's links that lets one more follow.
#: Rounds look at so many tokens from either end of a prefix. None of these loses a link: the rest that follows looks at all.
LEADERS, ROUNDS, WORTHWHILE, ENDS = 2, 4, 0.1, 16
#: Nodes of a token's group that one task takes, in a round and on either side of the rest.
GROUP_NODES, SIDE_NODES = 4096, 1024


def shingles(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: the first text, each text's set size, and all sets' members as (text in the slice, hash), sorted.

    A text with fewer words than a shingle has all of them as its one shingle; one without words has none.
    """
    for a, b in H.slices(texts):
        hashes, counts = H.words(texts[a:b], lower=True)
        doc = np.repeat(np.arange(len(counts)), counts)
        places = H.starts_within(counts, size)
        values = H.runs(hashes, size)
        firsts = (np.cumsum(counts) - counts).astype("i8")
        for m in range(1, size):
            some = firsts[counts == m]
            values[some] = H.runs(hashes, m)[some]
            places[some] = True
        doc, values = doc[places], values[places]
        order = np.lexsort((values, doc))
        doc, values = doc[order], values[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
        doc, values = doc[new], values[new]
        yield a, np.bincount(doc, minlength=len(counts)), doc, values


def _encoded(table: pa.Table, ids: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a batch, only those of the given ids, each once."""
    own = table.column("doc_id").to_numpy()
    keep = np.arange(len(own)) if ids is None else np.flatnonzero(np.isin(own, ids))
    own = own[keep]
    text = table.column("text").take(pa.array(keep)).to_pylist()
    return own, [(t or "").encode() for t in text]


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of text), n, s1, s2: the size of each set and two sums over its mixed members, equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            n, sums = [np.zeros(0, "i8")], [[np.zeros(0, "u8")], [np.zeros(0, "u8")]]
            for _, sizes, doc, values in shingles(texts, size):
                n.append(sizes)
                for k in (0, 1):
                    total = np.zeros(len(sizes), "u8")
                    np.add.at(total, doc, H.mix(values, 11 + k))
                    sums[k].append(total)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.concatenate(n).astype("i8")), *(pa.array(np.concatenate(s).view("i8")) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "n", "s1", "s2"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, size long, n long, s1 long, s2 long")


def prefixes(docs: DataFrame, nodes: DataFrame, size: int, percent: int, batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The nodes with a prefix token that another node has: doc_id, n, tokens, places, times, second, third, members.

    tokens: of the prefix by frequency, those of two nodes or more, rare first, their places in it and
    the numbers of nodes that have them; second, third: the prefixes under two orders by hash, 32 bits of
    each, packed; members: the set, packed.
    """
    parts = -(-batches // 4)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    dealt = id_text(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", "text", batch).groupBy("batch")
    listed = nodes.select("doc_id", batch).groupBy("batch").agg(F.collect_list("doc_id").alias("ids"))
    none = lambda name: F.lit(None).cast("binary").alias(name)
    count_shift, set_shift = np.uint64(64 - COUNT_BITS), np.uint64(64 - SET_BITS)

    def chosen(side: pa.Table) -> np.ndarray:
        ids = [np.array(x, "i8") for x in side.column("ids").to_pylist() if x is not None]
        return np.concatenate([np.zeros(0, "i8"), *ids])

    def count(table: pa.Table, side: pa.Table) -> pa.Table:
        """First pass: the distinct shingles of the batch's nodes, and how many nodes have each."""
        out = {"part": [], "batch": [], "hashes": [], "counts": []}
        if table.num_rows and side.num_rows:
            _, texts = _encoded(table, chosen(side))
            values, counts = np.unique(np.concatenate([np.zeros(0, "u8"), *(v >> count_shift for _, _, _, v in shingles(texts, size))]), return_counts=True)
            cuts = np.searchsorted(values, (np.arange(1, parts, dtype="object") * (1 << COUNT_BITS) // parts).astype("u8"))
            edges = [0, *cuts, len(values)]
            for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    out["part"].append(part), out["hashes"].append(H.pack_sorted(values[a:b])), out["counts"].append(H.pack(counts[a:b]))
            out["batch"] = [table.column("batch")[0].as_py()] * len(out["part"])
        return pa.table({k: pa.array(v, pa.binary() if k in ("hashes", "counts") else pa.int32()) for k, v in out.items()})

    def total(table: pa.Table) -> pa.Table:
        """The corpus's counts of one range of shingles: those of two nodes or more go back to their batches."""
        batches = table.column("batch").to_pylist()
        values = [H.unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([H.unpack(x) for x in table.column("counts").to_pylist()])
        sizes, values = [len(v) for v in values], np.concatenate(values)
        order = np.argsort(values, kind="stable")
        new = np.flatnonzero(np.diff(values[order], prepend=~values[order][:1]) != 0)
        sums = np.zeros(len(values), "u8")
        sums[order] = np.repeat(np.add.reduceat(counts[order], new), np.diff(np.append(new, len(values))))
        out, at = {"batch": [], "hashes": [], "counts": []}, 0
        for b, n in zip(batches, sizes, strict=True):
            many = sums[at : at + n] > 1
            if many.any():
                out["batch"].append(b), out["hashes"].append(H.pack_sorted(values[at : at + n][many])), out["counts"].append(H.pack(sums[at : at + n][many]))
            at += n
        return pa.table({k: pa.array(v, pa.int32() if k == "batch" else pa.binary()) for k, v in out.items()})

    def cut(table: pa.Table, side: pa.Table) -> pa.Table:
        """Second pass: the prefixes."""
        out = {k: [] for k in ("doc_id", "n", "tokens", "places", "times", "second", "third", "members")}
        if table.num_rows and side.num_rows:
            rows = [(h, c) for h, c in zip(side.column("hashes").to_pylist(), side.column("counts").to_pylist(), strict=True) if h is not None]
            known = np.concatenate([np.zeros(0, "u8"), *(H.unpack_sorted(h) for h, _ in rows)])
            times = np.concatenate([np.zeros(0, "u8"), *(H.unpack(c) for _, c in rows)])
            by = np.argsort(known)
            known, times = known[by], times[by]
            ids, texts = _encoded(table, chosen(side))
            for first, sizes, doc, values in shingles(texts, size) if len(known) else ():
                short = values >> count_shift
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                df = np.where(known[at] == short, times[at], np.uint64(1))
                length = sizes - (percent * sizes + 99) // 100 + 1
                starts = np.cumsum(sizes) - sizes
                place = np.arange(len(doc)) - starts[doc]  # rows of a text stand together in any order of theirs
                order = np.lexsort((values, df, doc))
                token = (place < length[doc]) & (df[order] > 1)
                tokens, places, often, owner = values[order][token].view("i8"), place[token], df[order][token], doc[token]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
                second, third = (m[np.lexsort((m, doc))] >> np.uint64(32) for m in (H.mix(values, 21), H.mix(values, 22)))
                for d in np.flatnonzero(np.diff(ends)):
                    a, p = starts[d], length[d]
                    out["doc_id"].append(ids[first + d]), out["n"].append(sizes[d]), out["tokens"].append(tokens[ends[d] : ends[d + 1]]), out["places"].append(places[ends[d] : ends[d + 1]])
                    out["times"].append(often[ends[d] : ends[d + 1]].astype("i8")), out["second"].append(H.pack_sorted(second[a : a + p])), out["third"].append(H.pack_sorted(third[a : a + p]))
                    out["members"].append(H.pack_sorted(values[a : a + sizes[d]] >> set_shift))
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int64()), "second": pa.binary(), "third": pa.binary(), "members": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    counted = dealt.cogroup(listed.groupBy("batch")).applyInArrow(count, "part int, batch int, hashes binary, counts binary")
    totals = counted.groupBy("part").applyInArrow(total, "batch int, hashes binary, counts binary")
    side = totals.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(listed.select("batch", none("hashes"), none("counts"), "ids"))
    return dealt.cogroup(side.groupBy("batch")).applyInArrow(cut, "doc_id long, n long, tokens array<long>, places array<int>, times array<long>, second binary, third binary, members binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), a staged table: the staged ones whose prefixes under both hash orders meet, and then whose sets are similar.

    Few pairs are broadcast to the sets, as Spark knows their size; else the sets' rows move to the pairs.
    """
    side = lambda k, *columns: sets.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            # of a prefix of L tokens at most n - (least intersection) are not in the other set; the rest is in the
            # other's prefix too, for the side whose prefix ends first
            least = -(-(n_a + n_b) * percent // (100 + percent))
            keep = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
            for one, two in ((4, 5), (6, 7)):
                for k in np.flatnonzero(keep):
                    p, q = H.unpack_sorted(batch.column(one)[k].as_py()), H.unpack_sorted(batch.column(two)[k].as_py())
                    keep[k] = np.isin(p, q).sum() >= min(len(p) - n_a[k], len(q) - n_b[k]) + least[k]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = H.unpack_sorted(p), H.unpack_sorted(q)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    brief = ("n", "second", "third")
    both = pairs.join(side("a", *brief), "a").join(side("b", *brief), "b").select("a", "b", *(f"{c}_{k}" for c in brief for k in "ab"))
    near = staged(both.mapInArrow(meet, "a long, b long"), "near")
    links = staged(near.join(side("a", "members"), "a").join(side("b", "members"), "b").select("a", "b", "members_a", "members_b").mapInArrow(check, "a long, b long"), "links")
    cleared(pairs, near)
    return links


def crossing(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (x, y) of different labels that links (a, b) connect, x the larger one."""
    name = lambda c: labels.select(F.col("doc_id").alias(c), F.col("label").alias(f"label_{c}"))
    edges = links.join(name("a"), "a").join(name("b"), "b")
    return edges.select(F.greatest("label_a", "label_b").alias("x"), F.least("label_a", "label_b").alias("y")).filter("x > y")


def hooked(labels: DataFrame, links: DataFrame) -> DataFrame | None:
    """Staged labels after every label that links connect to smaller ones has gone to the smallest, and on along three more hooks; None if none does."""
    roots = staged(crossing(labels, links).groupBy("x").agg(F.min("y").alias("y")), "roots")
    if roots.isEmpty():
        cleared(roots)
        return None
    up, far = roots.select(F.col("x").alias("y"), F.col("y").alias("z")), roots
    for _ in range(3):
        far = far.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
    # a label is looked up once and not for each of its nodes, so that a large component is in no one task
    named = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")).join(far.withColumnRenamed("x", "label"), "label", "left")
    out = staged(with_group(labels, named, ["label"]).select("doc_id", F.coalesce("y", "label").alias("label")), "labels")
    cleared(roots, labels)
    return out


def _rounds(sets: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Labels and links after the rounds of leaders."""
    found, most = [], 0
    part = lambda n: F.ceil(n / GROUP_NODES).cast("int")
    # the rarest and the commonest tokens of a prefix; a node whose prefix has few tokens of its own alone is near the middle of what it is like
    ends = lambda c: F.when(F.size(c) <= 2 * ENDS, F.col(c)).otherwise(F.concat(F.slice(c, 1, ENDS), F.slice(c, -ENDS, ENDS)))
    brief = sets.select("doc_id", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.size("tokens")).alias("lone"), F.arrays_zip(ends("tokens").alias("token"), ends("times").alias("times")).alias("t"))
    for turn in range(ROUNDS):
        own = brief.join(labels, "doc_id").select("doc_id", "label", "lone", F.inline("t")).withColumn("part", F.pmod(F.xxhash64("doc_id"), part(F.col("times"))).cast("int"))
        chance = F.xxhash64("doc_id", F.lit(turn))
        leader = F.min_by(F.struct("doc_id", "label"), F.struct("lone", chance) if turn % 2 == 0 else F.struct(chance))
        groups = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), leader.alias("leader"), F.max("times").alias("times")).filter("low < high")
        groups = groups.select("token", F.col("leader.doc_id").alias("b"), F.col("leader.label").alias("other"), F.explode(F.sequence(F.lit(0), part(F.col("times")) - 1)).alias("part"))
        apart = own.join(groups, ["token", "part"]).filter("label <> other")
        pairs = apart.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))
        # a node's leaders are no more than its tokens; those with which it shares most go first
        best = pairs.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), False), 1, LEADERS).alias("best"))
        links = verified(staged(best.select("a", F.explode("best").alias("x")).select("a", "x.b"), "pairs"), sets, percent)
        found.append(links)
        n = links.count()
        labels = (n and hooked(labels, links)) or labels
        most = max(most, n)
        if turn and n <= WORTHWHILE * most:
            break
    return labels, found


def _rest(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different labels that share a prefix token, whole.

    Of a prefix token's nodes only pairs of fitting sizes meet: a set of n is in a class by log n, and
    meets those of its own and the next class. Large groups are cut into blocks, each of which meets each.
    What stands before the first token that two prefixes share is not in the other set, so that the places
    of that token bound the intersection; at later tokens the bound may drop the pair without loss.
    """
    side = lambda n: F.ceil(n / SIDE_NODES).cast("int")
    own = sets.join(labels, "doc_id").select("doc_id", "n", "label", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("place"), F.col("times").alias("times"))))
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id"), side(F.col("times"))).cast("int"))
    split = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("times").alias("times")).filter("low < high")
    split = staged(split.select("token", F.explode(F.sequence(F.lit(0), side(F.col("times")) - 1)).alias("part")), "split")
    step = math.log(100 / percent) if percent < 100 else 1e-9
    own = staged(own.join(split, ["token", "part"]).withColumn("class", F.floor(F.log("n") / step + 1e-6).cast("long")), "apart")
    every = F.sequence(F.lit(0), side(F.col("times")) - 1)
    # of the smaller set of a pair that the bound below lets through, only the first places can be it
    x = own.filter(F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)).select("token", "class", F.col("part").alias("i"), F.explode(every).alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "place", "label")))
    y = own.select("token", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"), F.explode(every).alias("i"), F.col("part").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "place", "label")))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("label_a") != F.col("label_b"))
    bound = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    pairs = x.join(y, ["token", "class", "i", "j"]).filter(smaller & fits & bound).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    links = verified(staged(pairs, "pairs"), sets, percent)
    cleared(split, own)
    return links


def components(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id and label (the smallest doc_id of its component) of the rows of prefixes(), staged.

    Nodes of one label are in one component at every time; at the end those of one component have one label.
    """
    labels, found = _rounds(sets, staged(sets.select("doc_id", F.col("doc_id").alias("label")).distinct(), "labels"), percent)
    found.append(_rest(sets, labels, percent))
    every = reduce(DataFrame.union, found)
    while (more := hooked(labels, every)) is not None:
        labels = more
    cleared(*found)
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row.

    A text's set holds its distinct runs of `size` words, A-Z lower-cased; two rows link when
    100 * intersection >= percent * union. Null and wordless texts: the empty set, linked with nothing.
    Shorter texts: one shingle of all words. Null ids: linked with nothing, component_id is null. Equal
    sets: always linked; repeated rows are. Rows of one id are one node. Empty table: no rows.
    """
    signed = staged(signatures(docs, size, id_col, text_col), "signatures")
    real = signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2")
    nodes = staged(real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members")), "nodes")
    batches = batches_of(docs.sparkSession, signed.agg(F.sum("size")).first()[0] or 0)
    sets = staged(prefixes(docs, nodes.select(F.col("node").alias("doc_id")), size, percent, batches, id_col, text_col), "prefixes")
    labels = components(sets, percent)
    labelled = nodes.join(labels.select(F.col("doc_id").alias("node"), "label"), "node", "left").select("n", "s1", "s2", "members", F.coalesce("label", "node").alias("component_id"))
    found = with_group(real, labelled, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = staged(found.unionByName(signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "components")
    cleared(signed, nodes, sets, labels)
    return out


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; all columns kept. Rows with null ids stay."""
    gone = staged(near_duplicates(docs, size, percent, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
