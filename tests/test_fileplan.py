"""Plans of file layouts against a file tree walked in Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fileplan as P


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def units(spark, files, texts):
    got = P.units(frame(spark, [(1, f) for f in files], "root int, rel string"), frame(spark, [(1, f, t) for f, t in texts.items()], "root int, rel string, text string")).collect()
    return {r.rel: (r.primary, r.multi) for r in got}


def test_units_of_containers(spark):
    files = ["psx/a/game.cue", "psx/a/game.bin", "psx/a/b.m3u", "psx/z.m3u", "psx/a/lone.cue", "psx/a/old.gdi", "psx/a/t1.bin", "x.zip", "psx/b.cue"]
    texts = {
        "psx/a/game.cue": 'FILE "game.bin" BINARY\n', "psx/a/b.m3u": "#EXTM3U\ngame.cue\n", "psx/z.m3u": "a\\lone.cue\na/game.cue\n../x.zip\n", "psx/a/lone.cue": 'FILE "C:/odd.bin" BINARY\nFILE "gone.bin" BINARY', "psx/a/old.gdi": None, "psx/b.cue": 'FILE "a/../a/./t1.bin" BINARY',
    }
    assert units(spark, files, texts) == {
        "psx/a/b.m3u": ("psx/a/b.m3u", True), "psx/a/game.cue": ("psx/a/b.m3u", True), "psx/a/game.bin": ("psx/a/game.bin", False), "psx/a/lone.cue": ("psx/a/lone.cue", False), "psx/a/old.gdi": ("psx/a/old.gdi", False),
        "psx/z.m3u": ("psx/z.m3u", True), "x.zip": ("psx/z.m3u", True), "psx/b.cue": ("psx/b.cue", True), "psx/a/t1.bin": ("psx/b.cue", True),
    }


def plain_units(files, names):
    claimed, out = set(), {}
    for f in sorted(files):
        if f in names and f not in claimed:
            mine = {m for m in names[f] if m in files and m != f and m not in claimed}
            claimed |= mine | {f}
            out |= {m: (f, bool(mine)) for m in mine | {f}}
    return out | {f: (f, False) for f in files if f not in claimed}


@pytest.mark.parametrize("seed", range(3))
def test_units_in_order(spark, seed):
    pick = random.Random(seed)
    files = [f"{c}.m3u" for c in "abcdefghij"] + [f"{i}.chd" for i in range(8)]
    names = {f: [pick.choice(files) for _ in range(pick.randrange(4))] for f in files if f.endswith("m3u")}
    assert units(spark, files, {f: "\n".join(m) for f, m in names.items()}) == plain_units(set(files), names)


def run(tree, plan):
    """Carries a plan out on {path: content}, step by step, and refuses to write over a file."""
    tree, aside = dict(tree), []
    for r in plan:
        if r.status == "park":
            aside.append((r.dst, tree.pop(r.src)))
    for r in sorted((r for r in plan if r.status == "move"), key=lambda r: r.step):
        assert r.dst not in tree, r
        tree[r.dst] = tree.pop(r.src)
    for dst, content in aside:
        assert dst not in tree
        tree[dst] = content
    return tree


@pytest.mark.parametrize("seed", range(4))
def test_moves_in_an_order_that_works(spark, seed):
    pick = random.Random(seed)
    names = [f"f{i}" for i in range(60)]
    to = names[:30]
    pick.shuffle(to)
    want = dict(zip(names[:30], to)) | {f: pick.choice([None, f, f"g{pick.randrange(12)}", pick.choice(names)]) for f in names[30:]}
    plan = P.moves(frame(spark, [(1, f, d) for f, d in want.items()], "root int, rel string, dst string")).collect()
    after = run({f: f for f in names}, plan)
    assert sorted(after.values()) == sorted(names)
    by = {r.src: r for r in plan}
    assert set(by) == {f for f, d in want.items() if d and d != f}
    for f, d in want.items():
        if f in by and by[f].status != "taken":
            assert after[d] == f
        else:
            assert after[f] == f
    # whatever is refused has its place taken by another file in the end
    assert all(r.dst in after and after[r.dst] != r.src for r in plan if r.status == "taken")


def test_lists_and_emptied_folders(spark):
    files = frame(spark, [(1, f) for f in ("in/a (Disc 1).chd", "in/a (Disc 2).chd", "in/deep/x/b.chd", "in/keep/note.txt", "have/c.m3u", "p/c1.chd", "p/c2.chd", "top.chd")], "root int, rel string")
    done = frame(
        spark,
        [(1, "in/a (Disc 1).chd", "out/A (Disc 1)/a (Disc 1).chd", 0, "move"), (1, "in/a (Disc 2).chd", "out/A (Disc 1)/a (Disc 2).chd", 0, "move"), (1, "in/deep/x/b.chd", "b.chd", 0, "move"), (1, "p/c1.chd", "have/c1.chd", 0, "move"), (1, "p/c2.chd", "have/c2.chd", None, "taken"), (1, "top.chd", "t.chd", 0, "move")],
        "root int, src string, dst string, step int, status string",
    )
    lists = P.play_lists(done, files)
    assert [tuple(r) for r in lists.orderBy("dst").collect()] == [(1, "out/A (Disc 1)/A.m3u", "a (Disc 1).chd\na (Disc 2).chd\n"), (1, "playlist.m3u", "b.chd\nt.chd\n")]
    assert [tuple(r) for r in P.emptied(done, files, lists).collect()] == [(1, "in/deep/x", 3)]


def test_signatures(spark):
    rows = frame(spark, [("k", "b/x.bin", 5, 7), ("k", "a/y.bin", None, None), ("z", "q", 0, 1)], "key string, path string, size long, mtime long")
    assert {r.key: r.signature for r in P.signatures(rows, "key").collect()} == {"k": "y.bin:missing|x.bin:5:7", "z": "q:0:1"}


def test_nothing_to_do(spark):
    none = frame(spark, [], "root int, rel string")
    placed = P.targets(P.units(none, frame(spark, [], "root int, rel string, text string")), F.col("primary"), ["chd"])
    assert P.moves(placed).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_deal_files_few_times(spark):
    """What a plan returns reads staged rows as they are where no file waits for another; emptied folders are dealt once, by folder."""
    files = frame(spark, [(1, f) for f in ("in/a.cue", "in/a.bin", "in/deep/x/b.chd", "keep/note.txt")], "root int, rel string")
    texts = frame(spark, [(1, "in/a.cue", 'FILE "a.bin" BINARY'), (1, "in/lost.cue", 'FILE "deep/x/b.chd" BINARY')], "root int, rel string, text string")
    placed = P.targets(P.units(files, texts), F.concat(F.lit("out/"), "primary"), ["chd"])
    done, kept = P.planned(placed)
    assert exchanges(done) == 0 and exchanges(kept) == 0 and exchanges(P.vacated(done, kept, done.limit(0))) == 1
    assert sorted(map(tuple, done.collect())) == [(1, "in/a.bin", "out/in/a.bin", 0, "move"), (1, "in/a.cue", "out/in/a.cue", 0, "move"), (1, "in/deep/x/b.chd", "out/in/deep/x/b.chd", 0, "move")]
    assert [tuple(r) for r in kept.collect()] == [(1, "keep/note.txt")]
    assert sorted(map(tuple, P.vacated(done, kept, done.limit(0)).collect())) == [(1, "in", 1), (1, "in/deep/x", 3)]


def test_refused_files_keep_their_folders(spark):
    placed = frame(spark, [(1, "a/x", "c/z"), (1, "b/y", "c/z"), (2, "b/y", "c/z"), (2, "d/q", "e/r"), (2, "e/r", None)], "root int, rel string, dst string")
    done, kept = P.planned(placed)
    assert sorted((r.root, r.src, r.status) for r in done.collect()) == [(1, "a/x", "move"), (1, "b/y", "taken"), (2, "b/y", "move"), (2, "d/q", "taken")]
    assert sorted(map(tuple, kept.collect())) == [(1, "b/y"), (2, "d/q"), (2, "e/r")]
    assert sorted(map(tuple, P.vacated(done, kept, done.limit(0)).collect())) == [(1, "a", 1), (2, "b", 1)]


def test_staged_tables_leave_no_shuffle_files(spark):
    import glob

    from tessera.sources.staging import staged

    left = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))
    before = left()
    assert staged(spark.range(20000).selectExpr("id % 7000 as k").groupBy("k").count(), "counts").count() == 7000
    # those of the count itself are one row a task
    assert sum(os.path.getsize(f) for f in left() - before if f.endswith(".data")) < 10000


def test_lists_deal_discs_once(spark):
    """By folder: for telling names apart and for gathering them; the other exchange is of the folders that have a list."""
    files = frame(spark, [(1, "have/c.m3u"), (1, "in/a.chd")], "root int, rel string")
    rows = [(1, f"in/{n}", f"{to}/{n}", 0, "move") for to in ("out", "have") for n in ("a.chd", "b.chd")] + [(1, "other/a.chd", "out/a.chd", 0, "move"), (2, "in/a.chd", "out/a.chd", 0, "move")]
    lists = P.play_lists(frame(spark, rows, "root int, src string, dst string, step int, status string"), files)
    assert exchanges(lists) == 2
    assert [tuple(r) for r in lists.collect()] == [(1, "out/out.m3u", "a.chd\nb.chd\n")]


def test_moves_keep_only_what_they_read(spark):
    """Links, open containers and units are deleted when the moves are known; the games' rows and the places stay."""
    from tessera.plans.registry import QUERIES
    from tessera.sources.staging import shared_dir

    here = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(here))
    plan = QUERIES["file_moves"](spark, "/root/testdata/sf0.001")
    assert exchanges(plan) == 0 and {(r.step, r.status) for r in plan.select("step", "status").distinct().collect()} == {(0, "move")}
    left = {name.rpartition("-")[0] for name in set(os.listdir(here)) - before}
    assert "places" in left and not left & {"links", "hangs", "open", "found", "claimed", "units", "multi"}
