"""Names of platforms, years of games, aliases and lineages."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import gate, platforms as P
from tessera.operators import graphs


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<int>' if k == 'recorded' else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) or k in ('first', 'own', 'stated') else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "label,want", [("Nintendo DS", "nds"), ("nds", "nds"), ("Sega CD", "segacd"), ("TurboGrafx-16/PC Engine", "pce"), ("MS-DOS", "pc"), ("Atari ST/STE", "pc"), ("Game Boy Advance", "gba"), ("My Console 9", "myconsole9"), (None, ""), ("", "")]
)
def test_canon(spark, label, want):
    assert one(spark, P.canon(F.col("l")), l=label) == want


@pytest.mark.parametrize(
    "display,existing,want",
    [("Game Boy", ["gameboy", "pc"], "gameboy"), ("PC", ["ms-dos", "pc"], "pc"), ("PC", ["ms-dos", "dos"], "dos"), ("PlayStation", [], "ps1"), ("PlayStation", None, "ps1"), ("junk", ["junk"], None), (None, ["pc"], None)],
)
def test_catalog_label(spark, display, existing, want):
    rows = spark.createDataFrame([(display, existing)], "d string, e array<string>")
    assert rows.select(P.catalog_label(F.col("d"), F.col("e"))).first()[0] == want


@pytest.mark.parametrize("title,want", [("Doom 32X", "sega 32x"), ("Sonic CD", None), ("Liberation (CD32).iso", "amigacd32"), ("Doom32X", None), (None, None)])
def test_hardware_in_titles(spark, title, want):
    assert one(spark, P.from_title(F.col("t")), t=title) == want


@pytest.mark.parametrize(
    "entry,theirs,want",
    [("atari2600", ["PC", "Amiga CD32"], True), ("snes", ["SNES", "PlayStation"], False), ("unheard of", ["PlayStation 5"], False), ("nes", [], False), ("nes", None, False), ("pc", ["ps5"], False), ("psx", ["snes"], False), ("nes", ["nobody knows"], False), ("nes", [None, "", "ps2"], True)],
)
def test_contamination(spark, entry, theirs, want):
    rows = spark.createDataFrame([(entry, theirs)], "e string, t array<string>")
    assert rows.select(P.contamination_suspect(F.col("e"), F.col("t"))).first()[0] is want


@pytest.mark.parametrize(
    "recorded,first,own,store,stated,want",
    [([2020, 2016, None, 2016], 1999, 1998, False, None, [2016, 2020]), ([], 1999, 1998, False, None, [1999]), (None, None, 1998, False, None, [1998]), (None, None, 1998, True, None, None), ([1998], None, None, False, 1979, [1979, 1998]), ([1998], None, None, False, 2010, [1998]), (None, None, None, True, 1979, [1979])],
)
def test_game_years(spark, recorded, first, own, store, stated, want):
    rows = spark.createDataFrame([(recorded, first, own, store, stated)], "r array<int>, f int, o int, s boolean, u int")
    assert rows.select(P.game_years(*(F.col(c) for c in "rfosu"))).first()[0] == want


def test_safe_aliases(spark):
    rows = spark.createDataFrame([("Deathmatch Classic", ["DMC", "Death Match", None, "", "The"]), ("Contra", ["Probotector", "Con"]), ("Wolfenstein 3D", ["Wolf3d"])], "t string, a array<string>")
    assert [r[0] for r in rows.select(gate.safe_aliases(F.col("t"), F.col("a"))).collect()] == [["Death Match"], ["Probotector"], ["Wolf3d"]]


def test_lineage(spark):
    # 1 <- 2 edition <- 3 remaster; 4 remake of 3; 5 expansion of 1; 6 edition of 5; 7 remake of 6; 8, 9 in a circle; 10 hangs on what isn't there
    graph = [(1, 0, None, None), (2, 11, 1, 5), (3, 9, None, 2), (4, 8, None, 3), (5, 2, None, 1), (6, 10, 5, None), (7, 8, 0, 6), (8, 0, None, 9), (9, 0, None, 8), (10, 11, None, 99), (11, 8, None, None), (12, None, None, 1)]
    got = {r.id: (r.version_root, r.same_game_root, r.remake_of) for r in graphs.lineage(spark.createDataFrame(graph, "id long, type int, version_parent long, parent long")).collect()}
    assert got == {
        1: (1, 1, None), 2: (1, 1, None), 3: (1, 1, None), 4: (4, 4, 1), 5: (1, 5, None), 6: (1, 5, None), 7: (7, 7, 5), 8: (9, 9, None), 9: (8, 8, None), 10: (99, 99, None), 11: (11, 11, None), 12: (1, 12, None),
    }
