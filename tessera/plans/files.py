"""Queries that plan file layouts. Orders are games: their line items are discs, in folders of several shapes, with sheets and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.paths import last, rendered
from tessera.operators import fileplan as P
from tessera.sources.staging import released, staged
from tessera.sources.tables import table

from .registry import query

GAMES = ["bin", "chd", "cue", "m3u", "zip"]
SYSTEMS = ["snes", "psx", "pc"]

# by o_orderkey % 8: 0 sheets that a list names first, 4 sheets with their bins; 1, 5 discs; 2, 6 discs with a list; 3, 7 one disc a file and a note
_FILES_SQL = """g as (select o_orderkey as o, o_custkey % 20 as root, ['snes', 'psx', 'pc'][o_custkey % 3 + 1] as system, o_orderkey % 8 as k, case o_orderkey % 3 when 0 then '' when 1 then 'dump/' || o_orderkey % 400 || '/' else 'g' || o_orderkey || '/' end as dir from orders),
l as (select distinct root, system, k, dir, o, l_linenumber as n from g join lineitem on l_orderkey = o),
f as (select root, system || '/' || dir as base, o, k, 'g' || o || ' (Disc ' || n || ')' as stem, system from l),
files as (select root, base || stem || case when k % 4 = 0 then '.bin' when k % 4 = 3 then '.zip' else '.chd' end as rel, o, k, system, 'file' as what, stem, base from f
  union all select root, base || stem || '.cue', o, k, system, 'sheet', stem, base from f where k % 4 = 0
  union all select distinct root, base || case when k = 0 then 'a' else 'g' end || o || '.m3u', o, k, system, 'list', null, base from f where k in (0, 2, 6)
  union all select distinct root, base || 'g' || o || '.txt', o, k, system, 'note', null, base from f where k % 4 = 3),
u as (select *, case when k = 0 and what in ('sheet', 'list') then base || 'a' || o || '.m3u' when k = 4 then base || stem || '.cue' when k in (2, 6) then base || 'g' || o || '.m3u' else rel end as "primary", not (what = 'note' or k in (1, 3, 5, 7) or (k = 0 and what = 'file')) as multi from files),
p as (select *, case when what <> 'note' then system || '/' || case when k = 0 and what in ('sheet', 'list') then 'a' else 'g' end || o || '/' || regexp_replace(rel, '^.*/', '') end as dst from u),
moved as (select root, rel as src, dst from p where dst is not null and dst <> rel),
d as (select distinct root, regexp_replace(dst, '/[^/]*$', '') as folder, regexp_replace(dst, '^.*/', '') as name from moved where regexp_matches(dst, '[.](chd|cue)$')),
lists as (select root, folder || '/' || regexp_replace(folder, '^.*/', '') || '.m3u' as dst, string_agg(name, chr(10) order by name) || chr(10) as content from d
  where not exists (select 1 from files x where x.root = d.root and x.rel like '%.m3u' and regexp_replace(x.rel, '/[^/]*$', '') = d.folder) group by root, folder having count(*) > 1)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, texts), both made row by row of one staged table, which has a game with all its discs in a row."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("g"), key.cast("string"))
    folder = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("dump/"), (key % 400).cast("string"), F.lit("/"))).otherwise(F.concat(name, F.lit("/")))
    system = F.array(*map(F.lit, SYSTEMS))[(F.col("o_custkey") % 3).cast("int")]
    g = o.select(key.alias("o"), (F.col("o_custkey") % 20).alias("root"), (key % 8).alias("k"), name.alias("name"), F.concat(system, F.lit("/"), folder).alias("base"))
    # lines are dealt by order once, for telling discs apart and for the join
    discs = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).repartition("o").groupBy("o").agg(F.sort_array(F.collect_set(F.struct("n"))).alias("discs"))
    stem = lambda d: F.concat("name", F.lit(" (Disc "), d["n"].cast("string"), F.lit(")"))
    games = staged(discs.join(g, "o").select("root", "base", "k", "name", F.filter(F.transform("discs", stem), lambda s: s.isNotNull()).alias("stems")), "games")
    k, none = F.col("k"), F.array().cast("array<string>")
    end = F.when(k % 4 == 0, ".bin").when(k % 4 == 3, ".zip").otherwise(".chd")
    listed = F.concat("base", F.when(k == 0, F.concat(F.lit("a"), F.expr("substring(name, 2)"))).otherwise(F.col("name")), F.lit(".m3u"))
    of = lambda tail: F.transform("stems", lambda s: F.concat("base", s, tail))
    kinds = [of(end), F.when(k % 4 == 0, of(F.lit(".cue"))).otherwise(none), F.when(k.isin(0, 2, 6), F.array(listed)).otherwise(none), F.when(k % 4 == 3, F.array(F.concat("base", "name", F.lit(".txt")))).otherwise(none)]
    files = games.select("root", F.explode(F.concat(*kinds)).alias("rel"))
    sheet = lambda s: F.struct(F.concat("base", s, F.lit(".cue")).alias("rel"), F.concat(F.lit('FILE "'), s, F.lit('.bin" BINARY\n  TRACK 01 MODE2/2352\n')).alias("text"))
    sheets = games.filter("k % 4 = 0").select("root", F.explode(F.transform("stems", sheet)).alias("s")).select("root", "s.*")
    names = F.transform("stems", lambda s: F.concat(s, F.when(k == 0, ".cue").otherwise(".chd")))
    lists = games.filter("k in (0, 2, 6)").select("root", listed.alias("rel"), F.concat(F.lit("#EXTM3U\n"), F.array_join(F.sort_array(names), "\n")).alias("text"))
    return files, sheets.unionByName(lists)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moves, kept, files) of all games."""
    files, texts = _files(spark, sf_dir)
    primary = F.col("primary")
    game = F.regexp_extract(last(primary), r"^([a-z0-9]+)", 1)
    place = rendered("{system}/{game}/{filename}", {"system": F.substring_index(primary, "/", 1), "game": game, "filename": last(primary)})
    units = P.units(files, texts)
    done, kept = P.planned(P.targets(units, place, GAMES))
    released(units)
    return done, kept, files


@query(f"with {_FILES_SQL} select root, src, dst, 0 as step, 'move' as status from moved")
def file_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)[0]


@query(f"with {_FILES_SQL} select root, dst, content from lists")
def file_play_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _, files = _planned(spark, sf_dir)
    return P.play_lists(done, files)


@query(f"""with {_FILES_SQL}, kept as (select root, regexp_replace(rel, '/[^/]*$', '') as at from p where dst is null or dst = rel union select root, regexp_replace(dst, '/[^/]*$', '') from moved union select root, regexp_replace(dst, '/[^/]*$', '') from lists),
src as (select distinct root, regexp_replace(src, '/[^/]*$', '') as folder from moved)
select root, folder, len(string_split(folder, '/')) as depth from src where not exists (select 1 from kept where kept.root = src.root and (kept.at = src.folder or starts_with(kept.at, src.folder || '/')))""")  # fmt: skip
def file_emptied_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, kept, _ = _planned(spark, sf_dir)
    # a list is only written beside discs that have come, so the folder that it is in is alive by them
    return P.vacated(done, kept, done.limit(0))


@query("""select l_orderkey, string_agg('d' || l_linenumber || '.bin:' || case when l_quantity > 48 then 'missing' else cast(cast(floor(l_extendedprice) as bigint) as varchar) || ':' || cast(epoch(l_shipdate) as bigint) end, '|' order by 'x' || l_suppkey || '/d' || l_linenumber || '.bin',
case when l_quantity > 48 then 'missing' else cast(cast(floor(l_extendedprice) as bigint) as varchar) || ':' || cast(epoch(l_shipdate) as bigint) end) as signature from lineitem group by 1""")  # fmt: skip
def source_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = F.col("l_quantity") <= 48
    seconds = F.datediff(F.col("l_shipdate"), F.lit("1970-01-01")).cast("long") * 86400
    path = F.concat(F.lit("x"), F.col("l_suppkey").cast("string"), F.lit("/d"), F.col("l_linenumber").cast("string"), F.lit(".bin"))
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path"), F.when(here, F.floor("l_extendedprice")).alias("size"), F.when(here, seconds).alias("mtime"))
    return P.signatures(files, "l_orderkey")
