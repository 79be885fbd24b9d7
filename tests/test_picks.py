"""Picks by era and hardware, limits, and what was learned taken over."""

import pytest

from tessera.operators import identity as I, scoring as S
from tessera.sources import learned

ASKED = "key string, consoles array<string>, platform string, year int, unique boolean"
HITS = "key string, rank int, id int, year int, platforms array<string>"


@pytest.mark.parametrize(
    "asked,hits,want",
    [
        (("pc", None, False), [(1, 7, 1995, None), (2, 8, 1985, None)], 7), (("snes", None, False), [(1, 7, 1995, None), (2, 8, 1992, None)], 8), (("snes", None, False), [(1, 7, 2020, None)], None),
        (("snes", None, False), [(1, 7, None, None), (2, 8, 1995, None)], 8), (("snes", None, False), [(1, 7, 1992, ["PC"]), (2, 8, 1995, ["Super Nintendo Entertainment System"])], 8),
        (("snes", None, False), [(1, 7, 1992, ["PC"]), (2, 8, 1995, ["Amiga"])], None), (("snes", None, False), [(1, 7, 1992, ["PC"]), (2, 8, 1995, [])], 7), (("pc", None, False), [(1, 7, 1992, ["SNES"]), (2, 8, 1995, ["NES"])], 7),
        (("pc", 1995, False), [(1, 7, 1992, None), (2, 8, 1995, None)], 8), (("pc", 1995, True), [(1, 7, 1995, None), (2, 8, 1995, None)], None), (("pc", None, True), [(1, 7, 1995, None)], 7), (("pc", None, False), [], None),
    ],
)
def test_era_picks(spark, asked, hits, want):
    platform, year, unique = asked
    rows = I.era_picks(spark.createDataFrame([("k", [platform], platform, year, unique)], ASKED), spark.createDataFrame([("k", *h) for h in hits], HITS)).collect()
    assert [(r.key, r.id) for r in rows] == [("k", want)]


def test_limits(spark):
    caps = [("p", "a", 10, 0, None, None), ("p", "b", None, 5, None, None), ("p", "c", None, None, 3, 100), ("p", "d", None, None, None, 100), ("p", "e", None, None, None, 100), ("p", "f", None, None, None, 100), ("p", "g", 0, None, None, None), ("p", "h", 1, None, None, 1)]
    usage = [("p", "a", 10, 1, 1, 0, False), ("p", "b", 99, 4, 1, 0, True), ("p", "c", 1, 1, 3, 500, True), ("p", "d", 1, 1, 1, 1, True), ("p", "e", 1, 1, 1, 100, False), ("p", "f", 0, 0, 0, 99, False), ("p", "g", 9, 9, 9, 9, True)]
    names = "scope string, key string, total long, input long, output long, cents long"
    got = S.enforced(spark.createDataFrame(usage, names + ", unpriced boolean"), spark.createDataFrame(caps, names), spark.createDataFrame([("p", "f"), ("p", "g")], "scope string, key string")).collect()
    assert {r.key: r.hit for r in got} == {"a": "total", "b": None, "c": "output", "d": "unpriced usage", "e": "budget", "f": "unpriced call", "g": None, "h": None}


def test_learned_rows_are_taken_over(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "ns string, val string, identity_id long")
    ids = lambda *n: spark.createDataFrame([(x,) for x in n], "id long")
    learned.exported({"identities": ids(1, 2), "keys": frame([("a", "x", 1), ("b", "y", 2)]), "overrides": frame([("a", "x", 9)])}, str(tmp_path / "out"))
    there = {"identities": ids(2, 3), "keys": frame([("a", "x", 7)]), "overrides": frame([("a", "x", 7), ("c", "z", None)])}
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    both = learned.imported(spark, str(tmp_path / "out"), there)
    assert rows(both["identities"]) == [(1,), (2,), (3,)] and rows(both["keys"]) == [("a", "x", 7), ("b", "y", 2)] and rows(both["overrides"]) == [("a", "x", 9), ("c", "z", None)]
    only = learned.imported(spark, str(tmp_path / "out"), there, replace=True)
    assert rows(only["keys"]) == [("a", "x", 1), ("b", "y", 2)] and rows(only["overrides"]) == [("a", "x", 9)]
    (tmp_path / "half").mkdir()
    with pytest.raises(Exception):
        learned.imported(spark, str(tmp_path / "half"), there)
