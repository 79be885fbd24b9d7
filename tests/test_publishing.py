"""Plans of publishing, refusals of identities and sets of targets."""

from tessera.operators import decisions as D, identity as I, publishing as B


def test_items(spark):
    t = spark.createDataFrame
    want = t([("a",), ("b",), ("c",), ("d",), ("e",), ("f",), ("g",), ("a",)], "key string")
    entries = t([(k, "psx" if k in "abcdg" else "snes") for k in "abcdefh"] + [("g", "pc")], "key string, system string")
    files = t([("a", 1, "bin", "s1", 10), ("a", 2, "bin", "s2", 20), ("b", 1, "zip", "s3", 5), ("c", 1, "zip", "new", 7), ("d", 1, "zip", "s5", 9), ("f", 1, "sfc", None, None), ("g", 1, "iso", "x", 3)], "key string, disc int, ext string, sig string, bytes long")
    ledger = t([("b", "s3"), ("c", "old"), ("d", "s5"), ("f", None), ("h", "s"), ("i", "s")], "key string, sig string")
    absent, formats, tools = t([("d",), ("i",)], "key string"), t([("psx", "bin", "chd", "chdman"), ("pc", "iso", "cso", "ciso")], "system string, ext string, target_ext string, tool string"), t([("chdman",)], "tool string")
    got = sorted(((r.key, r.disc or 0, r.action, r.tool, r.blocker) for r in B.items(want, entries, files, ledger, absent, formats, tools).collect()), key=str)
    assert got == sorted([
        ("a", 1, "convert", "chdman", None), ("a", 2, "convert", "chdman", None), ("b", 1, "skip", None, None), ("c", 1, "update", None, None), ("d", 1, "copy", None, None), ("e", 0, "blocked", None, "no source file"),
        ("f", 1, "skip", None, None), ("g", 1, "blocked", "ciso", "ciso not available"), ("h", 0, "remove", None, None), ("i", 0, "skip", None, None),
    ], key=str)
    unknown = B.items(t([("z",)], "key string"), entries, files, ledger.filter("false"), absent, formats, tools).collect()
    assert [(r.action, r.blocker) for r in unknown] == [("blocked", "unknown entry")]


def test_capacity_and_unmanaged(spark):
    t = spark.createDataFrame
    planned = t([("d1", "copy", 5), ("d1", "update", 6), ("d1", "skip", 100), ("d2", "convert", 3), ("d3", "copy", 9)], "target string, action string, bytes long")
    free = t([("d1", 10), ("d2", 3)], "target string, free long")
    assert {r.target: (r.need, r.free, r.over) for r in B.capacity(planned, free, "target").collect()} == {"d1": (11, 10, True), "d2": (3, 3, False), "d3": (9, None, False)}
    ledger = t([("d1", "a", ["b"]), ("d1", "c", None)], "target string, path string, extra array<string>")
    seen = t([("d1", "a"), ("d1", "b"), ("d1", "mine"), ("d2", "a")], "target string, path string")
    assert sorted(tuple(r) for r in B.unmanaged(seen, ledger).collect()) == [("d1", "mine"), ("d2", "a")]


def test_refused_identities(spark):
    t = spark.createDataFrame
    bindings = t([("ys 1", 10), ("ys 2", 10), ("contra", 20), ("probotector", 20), ("pack", 30), ("same", 40), ("same 2", 40), ("x", 50), ("y", 50)], "norm_key string, identity_id long")
    sources = t([("ys 1", "steam", "1"), ("ys 2", "steam", "2"), ("contra", "emulation", "a"), ("probotector", "emulation", "b"), ("same", "steam", "5"), ("same 2", "steam", "5"), ("x", "steam", "7"), ("y", "gog", "8"), ("pack", "steam", "9"), ("x", "gog", "")], "norm_key string, source string, source_id string")
    types = t([(30, 3), (10, 0)], "identity_id long, type int")
    assert sorted(tuple(r) for r in I.refused_identities(bindings, sources, types).collect()) == [("pack", 30, "compilation"), ("ys 1", 10, "many_to_one"), ("ys 2", 10, "many_to_one")]


def test_target_flags(spark):
    t = spark.createDataFrame
    games, links, attributes = t([(1,), (2,), (3,)], "game_id int"), t([(1, "igdb"), (1, "ss"), (2, "ss")], "game_id int, provider string"), t([(1, "genre"), (1, "maker"), (1, "genre"), (2, "genre"), (2, "other")], "game_id int, kind string")
    got = {r.game_id: tuple(r)[1:] for r in D.target_flags(games, links, attributes, ["genre", "maker"], "igdb").collect()}
    assert got == {1: (False, False, False), 2: (False, True, True), 3: (True, True, True)}
