"""Titles, the gate, confidence, shapes and names on known cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import assets, gate, names, titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "title, key",
    [
        ("Puyo Puyo™Tetris®", "puyo puyo tetris"), ("Foo©Bar", "foo bar"), ("Half-Life™", "half life"), ("BIOSHOCK™ INFINITE", "bioshock infinite"), ("The Legend of Zelda", "legend of zelda"),
        ("Legend of Zelda, The", "legend of zelda"), ("Mass Effect 2 (2010) Edition", "mass effect 2 2010"), ("Special Edition Racing", "racing"), ("Editions of Chaos", "editions of chaos"),
        ("Doom (USA) [!].zip", "doom"), ("Foo & Bar+", "foo and bar plus"), ("Final Fantasy VII", "final fantasy 7"), ("Mega Man X", "mega man x"), ("The A An", ""), (None, ""),
    ],
)
def test_norm(spark, title, key):
    assert one(spark, titles.norm(F.lit(title).cast("string"))) == key


def test_norm_on_a_platform(spark):
    assert one(spark, titles.norm(F.lit("Doom 32X"), F.lit("Sega 32X"))) == "doom"
    assert one(spark, titles.norm(F.lit("Doom 32X"), F.lit("pc"))) == "doom 32x"
    assert one(spark, titles.norm(F.lit("32X"), F.lit("Sega 32X"))) == "32x"


@pytest.mark.parametrize("title, cut, year", [("Mass Effect 2 (2021)", "Mass Effect 2", 2021), ("Portal 2", "Portal 2", None), ("Football Manager 2024", "Football Manager 2024", None), ("Doom (Classic)", "Doom (Classic)", None), ("Thing (1234)", "Thing (1234)", None)])
def test_store_year(spark, title, cut, year):
    assert one(spark, titles.store_title(F.lit(title))) == cut and one(spark, titles.store_year(F.lit(title))) == year


@pytest.mark.parametrize("title, cut", [("DARK SOULS: REMASTERED", "DARK SOULS"), ("Remastered", "Remastered"), ("Foo - Game of the Year Edition", "Foo"), ("Foo", "Foo"), ("Foo HD ", "Foo")])
def test_strip_edition(spark, title, cut):
    assert one(spark, titles.strip_edition(F.lit(title))) == cut


@pytest.mark.parametrize(
    "owned, candidate, ok",
    [
        ("Evoland", "Evoland II", False), ("Portal", "Portal 2", False), ("Contra", "Contra III", False), ("Devil May Cry", "Devil May Cry 4", False), ("Final Fantasy", "Final Fantasy 5", False),
        ("Little Nightmares", "Little Nightmares III", False), ("Mount & Blade", "Mount & Blade II: Bannerlord", False), ("The Walking Dead: Saints & Sinners", "The Walking Dead: Saints & Sinners - Chapter 2", False),
        ("Evoland 2", "Evoland II", True), ("Being a DIK", "Being a DIK: Season 1", True), ("The Walking Dead", "The Walking Dead : Saison 1", True), ("Foo", "Foo 1", True),
        ("Quake Mission Pack 1", "Quake Mission Pack No. I", True), ("Police Quest IV: Open Season", "Police Quest: Open Season", True), ("Mass Effect 2 (2021)", "Mass Effect 2", True), ("Megaman X4", "Mega Man X4", True),
    ],
)
def test_gate(spark, owned, candidate, ok):
    assert one(spark, gate.judged(F.lit(owned), F.lit(candidate))["ok"]) is ok
    assert one(spark, gate.best_judged(F.array(F.lit("zz"), F.lit(owned)), F.lit(candidate))["ok"]) is ok


@pytest.mark.parametrize(
    "title, years, year, later, ok",
    [
        ("Ape Out", [2019], 2019, False, True), ("Ape Out", [2019], 2021, False, False), ("Ape Out", [2019], 2021, True, True), ("Ape Out", None, 2021, False, True), ("Ape Out", [2019, 2020], None, False, True),
        ("Resident Evil 4", [2023], 2005, True, False), ("Fortnite", [2020], 2017, True, False),
    ],
)
def test_gate_years(spark, title, years, year, later, ok):
    own = F.array(*map(F.lit, years)) if years else F.lit(None).cast("array<int>")
    g = gate.judged(F.lit(title), F.lit(title), own, F.lit(year).cast("int"), later)
    assert bool(one(spark, g["ok"])) is ok


def test_confidence(spark):
    c = lambda m, a, listed, impossible: one(spark, gate.confidence(F.lit(m), F.lit(a).cast("string"), F.lit(listed), F.lit(impossible)))
    assert c("manual", "norun", False, True) == 100 and c("store_id", None, False, True) == 96 and c("name", "exact", True, False) == 85
    assert c("name", "interior", False, True) < 60 <= c("name", "anchored", True, False) < 85 and 60 <= c("name", "exact", False, False) < 85
    assert "impossible" in one(spark, gate.confidence_reason(F.lit("name"), F.lit("interior"), F.lit(False), F.lit(True)))


def test_anchor(spark):
    a = lambda key, *n: one(spark, titles.anchor_class(F.lit(key), F.array(*map(F.lit, n))))
    assert a("journey", "sims 4 journey to batuu") == "interior" and a("1943", "1943 battle of midway") == "anchored"
    assert a("journey", "journeys") == "norun" and a("a b", "x", "a b") == "exact" and a("", "a") == "norun"


@pytest.mark.parametrize("kind, w, h, ok", [("cover", 460, 215, False), ("cover", 600, 900, True), ("cover", None, None, True), ("cover", 500, 500, True), ("hero", 600, 900, False), ("logo", 1, 9, True), ("icon", 600, 300, False)])
def test_shape(spark, kind, w, h, ok):
    assert one(spark, assets.shape_ok(F.lit(kind), F.lit(w).cast("int"), F.lit(h).cast("int"))) is ok


def test_sizes_and_regions(spark):
    band = lambda k, w, h: one(spark, assets.resolution_band(F.lit(k), F.lit(w).cast("int"), F.lit(h).cast("int")))
    assert (band("cover", 600, 900), band("cover", 264, 352), band("cover", None, 5), band("fanart", 500, 500)) == (0, 2, 1, 0)
    w, h = assets.derived_size(F.lit("library_600x900.jpg"))
    assert (one(spark, w), one(spark, h)) == (600, 900)
    rank = lambda r: one(spark, assets.region_rank(F.lit(r).cast("string"), ["us", "eu"]))
    assert (rank("us"), rank("eu"), rank(None), rank("jp")) == (0, 1, 2, 3)


def test_names(spark):
    n = F.lit("Foo Bar (Europe) (En,Fr) (v1.1) (Rev A) (Disc 2) (2001) [!].chd")
    got = [one(spark, f(n)) for f in (names.bare_title, names.region, names.languages, names.version, names.revision, names.disc, names.verified, names.year, names.release_type)]
    assert got == ["Foo Bar", "Europe", "En,Fr", "v1.1", "Rev A", "Disc 2", True, 2001, None]
    assert one(spark, names.release_type(F.lit("X (Hack)"))) == "Hack" and one(spark, names.path_type(F.lit("a/4 Homebrew/x"))) == "Homebrew"


def test_paths(spark):
    from tessera.functions import paths

    f = lambda c: one(spark, c)
    assert [f(paths.ending(F.lit(x))) for x in ("a/b.ZIP", "a.b/c", "x")] == ["zip", "", ""]
    assert [f(paths.safe_ending(F.lit(x))) for x in ("PNG?x=1", "host/grid/abc", ".webp", "exe", "")] == ["png", "jpg", "webp", "jpg", "jpg"]
    kinds = {}
    for x in ("10p.png", "10.jpg", "10_hero.png", "10_icon.ico", "x.png"):
        appid, kind = paths.grid_asset(F.lit(x))
        kinds[x] = (f(appid), f(kind))
    assert kinds == {"10p.png": ("10", "cover"), "10.jpg": ("10", "header"), "10_hero.png": ("10", "hero"), "10_icon.ico": ("10", "icon"), "x.png": (None, None)}
    assert f(paths.container_members(F.lit('FILE "a b.bin" BINARY\n  TRACK 01\nFILE "c.bin" BINARY'))) == ["a b.bin", "c.bin"]
    assert f(paths.container_members(F.lit("#EXTM3U\nDisc 1.chd\nDisc 2.chd\n"))) == ["Disc 1.chd", "Disc 2.chd"]
    assert f(paths.rendered("{s}/{none}/{g}.{e}", {"s": F.lit("snes"), "none": F.lit(None).cast("string"), "g": F.lit(" A/B. "), "e": F.lit("sfc")})) == "snes/A-B.sfc"
    assert f(paths.file_title(F.lit("What's: up? "))) == "What_s_ up_"
    assert f(paths.guid(F.lit("doom"))) == f(paths.guid(F.lit("doom"))) != f(paths.guid(F.lit("doom 2"))) and len(f(paths.guid(F.lit("x")))) == 36
    assert [f(paths.duration(F.lit(s))) for s in (5, 70, 240, 1500, 5400, 90000)] == ["under a minute", "about a minute", "4 min", "25 min", "1.5 hours", "25 hours"]


def test_games_of_files(spark):
    from tessera.operators.grouping import games

    files = {
        1: "psx/Foo/Disc 1.chd", 2: "psx/Foo/Disc 2.chd", 3: "psx/Foo/cover.txt", 4: "gba/All/A (USA).gba", 5: "gba/All/B.gba", 6: "gba/All/C.gba", 7: "gba/All/readme.txt", 8: "gba/All/Deep Game/x.bin",
        9: "gba/Archive/Loose (Europe).zip", 10: "psp/Game (USA)/data/eboot.bin", 11: "gba/notes.txt",
    }
    rows = spark.createDataFrame([(i, p.split("/")[0], p) for i, p in files.items()], "id long, system string, path string")
    got = {r.id: r.game for r in games(rows, ["gba", "zip", "chd", "bin"]).collect()}
    assert got == {1: "Foo", 2: "Foo", 3: "Foo", 4: "A", 5: "B", 6: "C", 7: "", 8: "Deep Game", 9: "Loose", 10: "Game", 11: ""}


@pytest.mark.parametrize("name, want", [("disc 1", True), ("side\t b", True), ("cd-02", True), ("track_iv", True), ("part 123", False), ("disc one", False), ("my disc 1", False)])
def test_names_of_discs(spark, name, want):
    from tessera.operators.grouping import DISC

    assert one(spark, F.lit(name).rlike(DISC)) is want


def test_guid_is_a_name_based_uuid(spark):
    import uuid

    from tessera.functions import paths

    for key in ("doom", "", "Ôkami 2", "x" * 500):
        assert one(spark, paths.guid(F.lit(key))) == str(uuid.uuid5(uuid.UUID(paths.GUID_SPACE), key))
    assert one(spark, paths.guid(F.lit("doom"))) == "be4ba5f8-5d41-5a06-8d07-53ff9a33f714"


@pytest.mark.parametrize("name, want", [
    ("Sonic (HB)", "Homebrew"), ("Tetris (19xx)", "Homebrew"), ("Puzzle (Public Domain)", "Homebrew"), ("Final (Taikenban)", "Demo"), ("Zork [t1]", "Hack"), ("Mother (French v1.1)", "Translation"), ("Mother [T+Fre1.2]", "Translation"),
    ("Uplink (Hackers)", None), ("Derby (Demolition)", None), ("Prototype", None), ("X (Beta 2)", "Prototype"), ("X (Proto-1) [!]", "Prototype"), ("X (Hack, by Y)", "Hack"), ("X (Taito)", None), ("X (T-En) (Hack)", "Translation"), ("X [p2]", "Unlicensed"), ("X (Pre-Release)", "Prototype"),
])
def test_release_tags(spark, name, want):
    assert one(spark, names.release_type(F.lit(name))) == want


@pytest.mark.parametrize("name, want", [("A (U)", ["USA"]), ("A (JU) [!]", ["Japan", "USA"]), ("A (Netherlands)", ["Netherlands"]), ("A (USA, Canada)", ["USA", "Canada"]), ("A (Hong Kong)", ["Hong Kong"]), ("A (Rev A)", []), ("A", [])])
def test_regions(spark, name, want):
    assert one(spark, names.regions(F.lit(name))) == want


def test_eras(spark):
    from tessera.functions import eras

    ask = lambda p, y: one(spark, eras.impossible(F.lit(p), F.lit(y).cast("int")))
    assert [ask("NES ", 2000), ask("nes", 1999), ask("nes", 1950), ask("pc", 2050), ask("nes", None), ask("switch", 2050), ask("gb", 2006)] == [True, False, False, False, False, False, True]
    suspect = lambda p, of: one(spark, eras.contamination_suspect(F.lit(p), F.array(*map(F.lit, of)).cast("array<string>")))
    assert [suspect("gameboy", ["ps4", "pc"]), suspect("gameboy", ["pc"]), suspect("gameboy", ["gb", "ps4"]), suspect("pc", ["ps4"]), suspect("ps4", ["nes"]), suspect("nes", [])] == [True, False, False, False, False, False]


def test_unknown_grid_arguments_are_errors(spark):
    from tessera.operators import search

    rows = spark.createDataFrame([("a 100%", "pc", ["s"], ["cover"], 1, True, False, 5, "k"), ("b_c", "gba", ["t"], None, 0, False, False, None, "l")], "title string, platform string, sources array<string>, kinds array<string>, owned int, identified boolean, utility boolean, score int, norm_key string")
    none = search.Filters({}, {})
    titles = lambda **asked: [r.title for r in search.grid(rows, none, **asked).collect()]
    assert titles() == ["a 100%", "b_c"] and titles(q="0%") == ["a 100%"] and titles(q="_") == ["b_c"] and titles(sort=["-score"]) == ["a 100%", "b_c"]
    assert titles(status="wanted") == ["b_c"] and titles(has_kind="cover") == ["a 100%"] and titles(identified="unidentified") == ["b_c"] and titles(query="score:>9") == [] and titles(limit=1, offset=1) == ["b_c"]
    for wrong in ({"status": "some"}, {"identified": "x"}, {"include": ["no_such"]}, {"sort": ["-nothing"]}, {"limit": -1}):
        with pytest.raises(ValueError):
            titles(**wrong)


def test_best_of_titles_keeps_the_accepted_one(spark):
    """A title that is accepted after a refused one with a higher score doesn't win; a refused one never replaces an accepted one."""
    judge = lambda owned, c: one(spark, gate.judged(F.lit(owned), F.lit(c)))
    best = lambda owned, c: one(spark, gate.best_judged(F.array(*map(F.lit, owned)), F.lit(c)))
    refused, accepted = judge("Portal Stories", "Portal Stories 2"), judge("Portal", "Portal Stories Mel Extra 1")
    assert not refused["ok"] and best(["Portal Stories"], "Portal Stories 2") == refused
    assert accepted["ok"] and best(["zz", "Portal"], "Portal Stories Mel Extra 1") == accepted
    low, high = judge("Mega", "Mega Man X 1"), judge("Mega Man Legends", "Mega Man X 1")
    assert low["ok"] and not high["ok"]
    assert best(["Mega", "Mega Man Legends"], "Mega Man X 1") == low
    assert best(["Mega Man Legends", "Mega"], "Mega Man X 1") == (low if low["score"] > high["score"] else high)
