"""Functions by name in SQL, XML libraries and links."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import gate, names as N, titles as T, twins
from tessera.operators import links as L, scoring
from tessera.sources import xml

WORDS = ["Doom", "II", "2", "The", "of", ", The", "GOTY", "Edition", "(USA)", "(1998)", "[!]", "(Rev A)", "(En,Fr)", "(Disc 2)", "(v1.1)", "&", "+", "Café", "™", ": ", " - ", "X", "VII", "hd", ".zip", "Star", "Wars", "7", "definitive edition", "é"]


@pytest.fixture(scope="module")
def titles(spark):
    pick = random.Random(4)
    made = [" ".join(pick.choice(WORDS) for _ in range(pick.randrange(0, 7))) for _ in range(300)] + ["", None, "the", "Ys II: The Sky", "Ys: The Sky", "MegaMan", "Mega Man"]
    return spark.createDataFrame([(i, t, pick.choice(made)) for i, t in enumerate(made)], "i int, t string, u string")


def test_twins_have_the_values_of_the_columns(spark, titles):
    twins.register(spark)
    got = titles.selectExpr("i", "norm(t) as n", "gate_score(t, u) as g", "parse_name(t) as p").collect()
    p = F.struct(N.languages(F.col("t")).alias("languages"), N.version(F.col("t")).alias("version"), N.revision(F.col("t")).alias("revision"), N.disc(F.col("t")).alias("disc"), N.verified(F.col("t")).alias("verified"), N.year(F.col("t")).alias("year"))
    want = {r.i: r for r in titles.select("i", "t", T.norm(F.col("t")).alias("n"), gate.judged(F.col("t"), F.col("u")).alias("g"), p.alias("p")).collect()}
    for r in got:
        w = want[r.i]
        assert r.n == w.n, w.t
        assert (r.g.ok, r.g.score and round(r.g.score, 9)) == ((w.g.ok, round(w.g.score, 9)) if w.g else (None, None)), w.t
        if w.t is not None:
            assert (r.p.languages or "", r.p.version or "", r.p.revision or "", r.p.disc or "", r.p.verified, r.p.year) == tuple(x if k > 3 else x or "" for k, x in enumerate(w.p)), w.t


def test_library_score_in_sql(spark):
    pick = random.Random(1)
    rows = [(pick.randrange(30), pick.choice(["critic", "user"]), pick.choice([None, 10.0, 55.5, 99.0]), pick.choice([None, 0.0, 3.0, 500.0])) for _ in range(200)]
    ratings = spark.createDataFrame(rows, "k int, kind string, score double, votes double")
    twins.register(spark)
    got = {r.k: r.s for r in spark.sql("select k, library_score(kind, score, votes) as s from {r} group by k", r=ratings).collect() if r.s is not None}
    assert got == {r.k: r.universal for r in scoring.bayes(ratings, "k").collect()}


def test_explain_handles(spark):
    twins.register(spark)
    keys = spark.createDataFrame([(1, "steam", "7", "exact"), (1, "name", "doom", "derived"), (1, "name", "doom 1", "derived"), (2, "gog", "x", "exact")], "identity_id long, ns string, val string, kind string")
    got = spark.sql("select * from explain_handles(table({k}) partition by identity_id order by (ns, val))", k=keys).collect()
    said = {(r.identity_id, r.place): r.explanation for r in got}
    assert said == {
        (1, 1): "name doom: concluded from a name", (1, 2): "name doom 1: concluded from a name", (1, 3): "steam 7: stated by its source", (1, None): "3 keys of 2 kinds, 1 stated", (2, 1): "gog x: stated by its source", (2, None): "1 keys of 1 kinds, 1 stated",
    }
    with pytest.raises(Exception, match="table of keys"):
        spark.sql("select * from explain_handles(1)").collect()


LIBRARY = """<?xml version="1.0" standalone="yes"?>
<LaunchBox>
  <Game><ID>a</ID><Title>Doom &amp; Gloom</Title><Platform>PC</Platform><Genre>Shooter; ; Horror</Genre><DatabaseID>7</DatabaseID><ReleaseDate>1993-12-10T00:00:00</ReleaseDate><PlayCount>5</PlayCount></Game>
  <Game><ID>b</ID><Title> Quake </Title><Notes> old </Notes><ReleaseDate>soon</ReleaseDate></Game>
  <Game><ID>c</ID><Title></Title></Game>
  <Game><Title>Nobody's</Title><Custom>kept</Custom></Game>
  <AdditionalApplication><GameID>a</GameID></AdditionalApplication>
</LaunchBox>"""


@pytest.fixture
def library(tmp_path):
    folder = tmp_path / "Platforms"
    folder.mkdir()
    (folder / "Sega Saturn.xml").write_text(LIBRARY)
    return str(folder)


def test_games_of_platform_files(spark, library):
    got = {r.title: r for r in xml.platform_games(spark, library).collect()}
    assert set(got) == {"Doom & Gloom", "Quake", "Nobody's"}
    doom, quake = got["Doom & Gloom"], got["Quake"]
    assert (doom.platform, doom.source_id, doom.genres, doom.release_year, doom.release_date, doom.developers) == ("PC", "7", ["Shooter", "Horror"], 1993, "1993-12-10", None)
    assert (quake.platform, quake.source_id, quake.description, quake.release_year, got["Nobody's"].source_id) == ("Sega Saturn", "b", "old", None, "")


def test_foreign_elements_stay(spark, library, tmp_path):
    there = xml.elements(spark, library, "Game")
    ours = spark.createDataFrame([("a", "Doom", None, "9"), ("new", "Hexen", "PC", None)], "ID string, Title string, Platform string, Score string")
    rows = xml.merged(there, ours, "ID")
    xml.write(rows, str(tmp_path / "out"), "LaunchBox", "Game")
    again = xml.elements(spark, str(tmp_path / "out"), "Game")
    of = {r.ID: r.asDict() for r in again.collect()}
    assert set(of) == {"a", "b", "c", "new", None}
    assert of["a"]["Title"] == "Doom" and of["a"]["Platform"] == "PC" and of["a"]["PlayCount"] == "5" and of["a"]["Score"] == "9"
    assert of["new"]["Title"] == "Hexen" and of[None]["Custom"] == "kept"
    key = lambda df: sorted(map(str, (tuple((r.asDict().get(c) or "").strip() for c in rows.columns) for r in df.collect())))
    assert key(again) == key(rows)
    # merged once more with nothing new, written and read, the rows are the same
    xml.write(xml.merged(again, ours, "ID"), str(tmp_path / "twice"), "LaunchBox", "Game")
    assert key(xml.elements(spark, str(tmp_path / "twice"), "Game")) == key(again)


def test_links_are_made_anew(spark):
    games = spark.createDataFrame([(1, "doom", "PC"), (2, "doom", "switch"), (3, "quake", "pc"), (4, "hack", "pc"), (5, "dune", "pc")], "game_id int, norm_key string, platform string")
    ids = spark.createDataFrame([("igdb", "doom", "5", None), ("ss", "doom", "9", "Switch"), ("ss", "doom", "8", ""), ("igdb", "quake", "0", None), ("moby", "quake", "a/b", None), ("igdb", "hack", "6", None), ("moby", "doom", "doom-1", None), ("nobody", "doom", "1", None)], "provider string, norm_key string, provider_id string, platform string")
    pages = {"igdb": "i/%s", "ss": "s/%s", "moby": "m/%s"}
    new = L.rebuilt(games, ids, games.filter("game_id = 4"), pages, keyed=["ss"], slugs=["moby"])
    want = {(1, "igdb", "5", "i/5"), (2, "igdb", "5", "i/5"), (2, "ss", "9", "s/9"), (3, "moby", "a/b", None), (1, "moby", "doom-1", "m/doom-1"), (2, "moby", "doom-1", "m/doom-1")}
    assert {tuple(r) for r in new.collect()} == want
    old = spark.createDataFrame([(5, "ss", "12706", "s/12706"), (1, "igdb", "4", "i/4"), (1, "own", "1", "o")], "game_id int, provider string, provider_id string, url string")
    assert {tuple(r) for r in L.replaced(old, new, games, list(pages)).collect()} == want | {(1, "own", "1", "o")}
    part = {tuple(r) for r in L.replaced(old, new, games, list(pages), games.filter("norm_key = 'doom'")).collect()}
    assert part == {w for w in want if w[0] < 3} | {(5, "ss", "12706", "s/12706"), (1, "own", "1", "o")}
