"""Queries over paths and decisions: files into games, overrides, re-keying, target sets, resolution chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import paths as P
from tessera.operators import decisions as D, grouping as G
from tessera.sources.tables import table

from .adapters import pick
from .registry import query

_SHAPES = ("Archive/{n} (USA).zip", "All Releases/{n}.gba", "All Releases/readme.txt", "{n} (Europe)/data/eboot.bin", "{n}/Disc 1.chd", "{n}/Disc 2.chd", "USA/{n}.zip", "All Releases/{n} folder/x.iso", "images/{n}.png")
_FILES_SQL = "files as (select p_partkey as id, lower(p_type) as system, lower(p_type) || '/' || replace([" + ", ".join(f"'{s}'" for s in _SHAPES) + "][p_partkey % 9 + 1], '{n}', p_name) as path from part)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = pick(_SHAPES, "cast(p_partkey % 9 as int)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("system"), F.concat(F.lower("p_type"), F.lit("/"), F.replace(shape, F.lit("{n}"), F.col("p_name"))).alias("path"))


@query(f"""with {_FILES_SQL}, a as (select *, string_split(path, '/') as s from files),
b as (select id, system, s[len(s)] as name, list_filter(s[2:len(s) - 1], lambda d: true) as f from a),
c as (select *, case when len(f) > 0 and lower(f[1]) in ('archive', 'favorite', 'favorites', 'roms', 'usa', 'europe', 'japan', 'world', 'images', 'manuals', 'media', 'videos', 'boxart', 'snaps') then f[2:] else f end as rest from b),
d as (select *, rest[1] as top, rest[2] as sub, len(rest) as depth, regexp_matches(lower(name), '\\.(zip|gba|chd|iso|bin)$') as rom, trim(regexp_extract(regexp_replace(name, '\\.[A-Za-z0-9]{{1,4}}$', ''), '^([^(\\[]*)', 1)) as title from c),
e as (select *, depth = 1 and rom and regexp_matches(lower(title), '{G.DISC}') as disc, depth = 1 and rom and not regexp_matches(lower(title), '{G.DISC}') as inside from d),
f as (select *, bool_or(disc) over w as discs, bool_or(inside) over w as members from e window w as (partition by system, lower(top)))
select id, system, case when depth = 0 then case when rom then title else '' end when discs then trim(regexp_extract(top, '^([^(\\[]*)', 1)) when inside then title
  when members then case when depth > 1 then trim(regexp_extract(sub, '^([^(\\[]*)', 1)) else '' end else trim(regexp_extract(top, '^([^(\\[]*)', 1)) end as game from f""")  # fmt: skip
def game_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.games(_files(spark, sf_dir), ["zip", "gba", "chd", "iso", "bin"])


@query(f"""with {_FILES_SQL} select id, lower(regexp_extract(string_split(path, '/')[-1], '\\.([A-Za-z0-9]{{1,5}})$', 1)) as ending, system || '/' || rtrim(replace(trim(string_split(path, '/')[-1]), '/', '-'), '. ') as target,
case when lower(regexp_extract(string_split(path, '/')[-1], '\\.([A-Za-z0-9]{{1,5}})$', 1)) = 'png' then 'png' else 'jpg' end as safe, id % 7 * 1000 + id % 60 as seconds from files""")  # fmt: skip
def file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, path = _files(spark, sf_dir), F.col("path")
    target = P.rendered("{system}//{none}/{file}", {"system": F.col("system"), "none": F.lit(""), "file": P.last(path)})
    return f.select("id", P.ending(path).alias("ending"), target.alias("target"), P.safe_ending(P.ending(path)).alias("safe"), (F.col("id") % 7 * 1000 + F.col("id") % 60).alias("seconds"))


@query("""select p_partkey as id, case when p_partkey % 5 = 4 then null else cast(p_partkey as varchar) end as appid, [ 'cover', 'header', 'hero', 'icon', null][p_partkey % 5 + 1] as kind from part""")
def grid_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_partkey").cast("string"), pick(["p.png", ".jpg", "_hero.png", "_icon.ico", "x.png"], "cast(p_partkey % 5 as int)"))
    appid, kind = P.grid_asset(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), appid.alias("appid"), kind.alias("kind"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'user' else 'auto' end as origin, case when p_partkey % 3 = 0 then case when p_partkey % 6 = 0 then null else 'u' || p_size end else p_type end as value from part where p_partkey % 3 = 0 or p_partkey % 2 = 0""")
def user_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    auto = p.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("value"))
    user = p.filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("u"), F.col("p_size").cast("string"))).alias("value"))
    return D.prevailing(auto, user, ["p_partkey"], "value")


@query("""with r as (select c_custkey, c_mktsegment as seg, c_name as value, c_custkey % 100 as key from customer), m as (select *, case when key >= 50 then key - 50 else key end as k2, key < 50 as own from r),
p as (select *, row_number() over (partition by k2, seg order by own desc, c_custkey) as n from m) select k2 as key, seg, value, c_custkey from p where n = 1""")  # fmt: skip
def rekey_user_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("value"), (F.col("c_custkey") % 100).alias("key"))
    aliases = spark.range(50, 100).select(F.col("id").alias("alias"), (F.col("id") - 50).alias("target"))
    return D.rekeyed(c, aliases, "key", ["seg"], F.col("c_custkey")).select("key", "seg", "value", "c_custkey")


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, case when l_quantity > 30 then l_returnflag end as stamp from lineitem), a as (select l_orderkey, min(stamp) as one, count(distinct stamp) as n from r group by 1)
select l_orderkey, l_linenumber, l_partkey, coalesce(stamp, case when n = 1 then one end) as stamp from r join a using (l_orderkey)""")  # fmt: skip
def unanimous_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).alias("stamp"))
    return D.unanimous(li, "l_orderkey", "stamp")


@query("select l_orderkey, case when count(*) filter (l_returnflag = 'N') = 0 then arg_min(l_returnflag, (l_linenumber, l_returnflag)) end as kind from lineitem group by 1")
def release_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.struct("l_linenumber", "l_returnflag").alias("o"))
    return D.release_of(li, ["l_orderkey"], "kind", F.col("o"))


@query("""select o_orderkey, coalesce(o_orderpriority not in ('5-LOW'), true) and not (len(s) > 0 and len(list_filter(s, lambda x: x not in ('A', 'R'))) = 0) as allowed from orders left join (select l_orderkey, list_distinct(list(l_returnflag)) as s from lineitem group by 1) on l_orderkey = o_orderkey where s is not null""")
def provider_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("s"))
    return table(spark, sf_dir, "orders").join(s, "o_orderkey").select("o_orderkey", D.allowed(F.col("o_orderpriority"), F.col("s"), ["5-LOW"], ["A", "R"]).alias("allowed"))


@query("select doc_id, lang = 'fr' or lang = 'es' as hidden from documents")
def language_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.language_filter(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "de"], "hide").select("doc_id", "hidden")


@query("""with e as (select distinct p_name as norm_key, p_type as platform, p_size % 4 as game_key from part), a as (select p_name as norm_key, case when p_partkey % 2 = 0 then '' else p_type end as system, p_size % 4 as game_key from part where p_partkey % 50 < 3), u as (select distinct p_name as norm_key from part where p_partkey % 300 = 7)
select e.*, exists (select 1 from a where a.norm_key = e.norm_key and a.system = e.platform) or exists (select 1 from a where a.norm_key = e.norm_key and a.system = '' and a.game_key = e.game_key) or exists (select 1 from u where u.norm_key = e.norm_key) as has_cover from e""")  # fmt: skip
def cover_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_name").alias("norm_key"), F.col("p_type").alias("platform"), (F.col("p_size") % 4).alias("game_key")).distinct()
    a = p.filter("p_partkey % 50 < 3").select(F.col("p_name").alias("norm_key"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("system"), (F.col("p_size") % 4).alias("game_key"))
    return D.covered(e, a, p.filter("p_partkey % 300 = 7").select(F.col("p_name").alias("norm_key")))


def _learn(orders: DataFrame, customers: DataFrame) -> DataFrame:
    o = orders.select(F.col("o_orderkey").alias("find"), F.explode(F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("ns", "val"))
    k = customers.filter("c_custkey % 4 = 0").select(F.lit("cust").alias("ns"), F.col("c_custkey").cast("string").alias("val"), F.col("c_custkey").alias("identity_id"))
    return D.learned(o, k, 900_000)


@query("""with p as (select o_orderkey as find, 'cust' as ns, cast(o_custkey as varchar) as val from orders union all select o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d') from orders),
k as (select 'cust' as ns, cast(c_custkey as varchar) as val, c_custkey as i from customer where c_custkey % 4 = 0), h as (select find, min(i) as hit from p left join k using (ns, val) group by 1)
select find, ns, val, coalesce(hit, find + 900000) as identity_id, hit is null as minted from p join h using (find)""")  # fmt: skip
def learn_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learn(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


@query("""with v as (select o_orderkey as id, ['unique', 'ambiguous', 'none_uncertain'][o_orderkey % 3 + 1] as kind, o_custkey as primary_id, (o_orderkey % 11) / 10.0::double as conf, o_orderkey % 5 = 0 as same, o_orderkey % 7 = 0 as det, case when o_orderkey % 2 = 0 then o_orderkey * 10 end as other from orders),
a as (select *, case when kind = 'unique' then 'set' when conf >= 0.75::double and not same and det then 'detach' when conf >= 0.75::double and not same and other is not null then 'set' else 'keep' end as action from v)
select id, action, case when kind = 'unique' then id when action = 'detach' then null when action = 'set' then other else primary_id end as identity_id from a""")  # fmt: skip
def combined_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    action, who = D.decided(pick(["unique", "ambiguous", "none_uncertain"], "cast(o_orderkey % 3 as int)"), k, F.col("o_custkey"), (k % 11) / 10.0, k % 5 == 0, k % 7 == 0, F.when(k % 2 == 0, k * 10))
    return o.select(k.alias("id"), action.alias("action"), who.alias("identity_id"))


@query("""with q as (select c_custkey as key from customer), c as (select c_custkey as key, case when c_custkey % 6 = 0 then c_custkey * 2 end as id, c_custkey % 40 as seen from customer where c_custkey % 2 = 0), i as (select c_custkey as key, c_custkey + 7 as id from customer where c_custkey % 5 > 1)
select key, case when c.id is not null then c.id when seen is not null and seen >= 20 then null when i.id is not null then i.id end as id, case when c.id is not null then 'cached' when seen is not null and seen >= 20 then 'miss' when i.id is not null then 'index' else 'search' end as how from q left join c using (key) left join i using (key)""")  # fmt: skip
def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    cached = c.filter("key % 2 = 0").select("key", F.when(F.col("key") % 6 == 0, F.col("key") * 2).alias("id"), (F.col("key") % 40).alias("at"))
    return D.resolved(c.select("key"), cached, c.filter("key % 5 > 1").select("key", (F.col("key") + 7).alias("id")), 50, 30)


@query("""with s as (select o_custkey as id, split_part(o_orderpriority, '-', 2) as series from orders where o_orderstatus <> 'P' group by all), n as (select id, count(distinct series) as n from s group by 1), t as (select c_custkey as id, 'The ' || c_mktsegment || ' urgent medium' as title from customer)
select distinct s.id, s.series from s join n using (id) join t using (id) where n < 4 or contains(lower(title), lower(series)) or (length(split_part(lower(series), ' ', 1)) >= 5 and starts_with(lower(title), split_part(lower(series), ' ', 1)))""")  # fmt: skip
def series_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("series")).distinct()
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("The "), "c_mktsegment", F.lit(" urgent medium")).alias("title"))
    return D.series_members(s, t)


@query("select l_orderkey, l_partkey from lineitem where l_returnflag = 'N' and not exists (select 1 from lineitem n where n.l_returnflag = 'A' and n.l_orderkey = lineitem.l_orderkey) union all select l_orderkey, l_partkey from lineitem where l_returnflag = 'A'")
def replace_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = lambda f: li.filter(F.col("l_returnflag") == f).select("l_orderkey", "l_partkey")
    return D.replaced(part("N"), part("A"), "l_orderkey")


@query("select p_name, p_partkey, p_type in ('PROMO', 'SMALL') and not bool_or(p_size = 50) over (partition by p_name) as blocked from part")
def unofficial_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("norm_key"), F.col("p_type").alias("kind"), (F.col("p_size") == 50).alias("is_store"))
    return D.unofficial(e, ["PROMO", "SMALL"]).select(F.col("norm_key").alias("p_name"), "p_partkey", "blocked")


@query("""with m as (select p_partkey, case when p_size in (7, 8) then 'merged' else p_name end as key, p_brand, p_retailprice from part) select key, p_brand, count(*) as n, cast(sum(round(p_retailprice * 100)) as bigint) as cents, min(p_partkey) as first from m group by all""")
def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge only renames keys; whatever is derived from rows is derived again, so it equals a rebuild."""
    m = table(spark, sf_dir, "part").withColumn("key", F.when(F.col("p_size").isin(7, 8), "merged").otherwise(F.col("p_name")))
    return m.groupBy("key", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("p_retailprice") * 100)).cast("long").alias("cents"), F.min("p_partkey").alias("first"))


@query("""select c_custkey, n is null as unmatched, coalesce(f, 0) = 0 as unidentified, coalesce(k, 0) < 5 as missing from customer left join (select o_custkey, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as f, count(distinct o_orderpriority) as k from orders where o_orderkey % 40 < 6 group by 1) on o_custkey = c_custkey""")
def target_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as games: some of their orders are links, by priority of a provider, and attributes by kind."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 40 < 6").select(F.col("o_custkey").alias("game_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderpriority").alias("kind"))
    games = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("game_id"))
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return D.target_flags(games, o, o, kinds, "1-URGENT").withColumnRenamed("game_id", "c_custkey")


@query("select o_orderpriority as kind, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def findings_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).pivot("o_orderstatus", ["F", "O", "P"]).count().select("kind", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("select child, parent from (select p_partkey as child, 'addon ' || p_name as k, p_name from part where p_size < 10) a join (select p_name, min(p_partkey) as parent from part where p_size >= 40 group by 1) b using (p_name)")
def addon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parents = p.filter("p_size >= 40").groupBy("p_name").agg(F.min("p_partkey").alias("parent"))
    return p.filter("p_size < 10").select(F.col("p_partkey").alias("child"), "p_name").join(parents, "p_name").select("child", "parent")


@query(f"""with h as (select p_partkey, sha1(from_hex('{P.GUID_SPACE.replace('-', '')}') || encode(p_name)) as h from part)
select p_partkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) as guid from h""")  # fmt: skip
def stable_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.guid(F.col("p_name")).alias("guid"))
