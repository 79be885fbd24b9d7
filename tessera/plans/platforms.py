"""Queries over names of platforms, years of games, aliases and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import eras as E, gate, platforms as P
from tessera.operators import graphs as G, identity as I
from tessera.sources.tables import table

from . import adapters as A
from .registry import query

_NAMES = sorted({a for names in P.ALIASES.values() for a in names.split()}) + ["unheardof", "pc windows", ""]
_LIBRARY = ["gameboy", "ms-dos", "sega 32x", "pc", "psx", "junk"]
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_CANON_SQL = f"canon(alias, c) as (values {', '.join(f"('{a}', '{c}')" for c, names in P.ALIASES.items() for a in names.split())})"
_GEN_SQL = f"gens(c, gen) as (values {', '.join(f"('{k}', {v})" for k, v in E.GENERATIONS.items())})"


@query(f"""with {_CANON_SQL}, {A.TITLES_SQL}, p as (select p_partkey, title_raw, upper(substring(n, 1, 2)) || '-' || substring(n, 3) as display, n from (select *, {_LIST}[p_partkey % {len(_NAMES)} + 1] as n from titles)),
lib as (select l, coalesce(c, regexp_replace(lower(l), '[^a-z0-9]', '', 'g')) as lc from (select unnest([{', '.join(f"'{x}'" for x in _LIBRARY)}]) as l) left join canon on alias = regexp_replace(lower(l), '[^a-z0-9]', '', 'g')),
c as (select p.*, coalesce(canon.c, regexp_replace(n, '[^a-z0-9]', '', 'g')) as canonical, canon.c is not null as known from p left join canon on alias = regexp_replace(n, '[^a-z0-9]', '', 'g'))
select p_partkey, display, canonical, case when known then coalesce((select l from lib where l = canonical), (select min(l) from lib where lc = canonical), canonical) end as label, case when contains(title_raw, '32X') then 'sega 32x' end as titled from c""")  # fmt: skip
def platform_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.titles(spark, sf_dir)
    name = A.pick(_NAMES, f"cast(p_partkey % {len(_NAMES)} as int)")
    display = F.concat(F.upper(F.substring(name, 1, 2)), F.lit("-"), F.expr("substring(n, 3)"))
    rows = t.withColumn("n", name).withColumn("display", display)
    return rows.select("p_partkey", "display", P.canon(F.col("display")).alias("canonical"), P.catalog_label(F.col("display"), F.array(*map(F.lit, _LIBRARY))).alias("label"), P.from_title(F.col("title_raw")).alias("titled"))


@query(f"""with {_CANON_SQL}, {_GEN_SQL}, p as (select p_partkey as id, {_LIST}[p_partkey % {len(_NAMES)} + 1] as entry from part), q as (select id, unnest(range(0, id % 4)) as i from p), th as (select distinct id, coalesce(c, regexp_replace(n, '[^a-z0-9]', '', 'g')) as c from (select id, {_LIST}[(id + 7 * i + 3) % {len(_NAMES)} + 1] as n from q) left join canon on alias = regexp_replace(n, '[^a-z0-9]', '', 'g') where n <> ''),
e as (select id, c from p left join canon on alias = regexp_replace(entry, '[^a-z0-9]', '', 'g')), a as (select e.id, e.c, max(th.c = e.c) as among, min(g.gen) as first from e left join th using (id) left join gens g on g.c = th.c group by all)
select a.id, coalesce(a.c is not null and not among and g.gen < first, false) as suspect from a left join gens g on g.c = a.c""")  # fmt: skip
def platform_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    at = lambda k: F.get(names, (k % len(_NAMES)).cast("int"))
    key = F.col("p_partkey")
    theirs = F.when(key % 4 > 0, F.transform(F.sequence(F.lit(0), (key % 4 - 1).cast("int")), lambda i: at(key + i * 7 + 3)))
    return table(spark, sf_dir, "part").select(key.alias("id"), P.contamination_suspect(at(key), theirs).alias("suspect"))


@query("""with l as (select l_partkey as k, list_sort(list_distinct(list(year(l_shipdate)) filter (l_linenumber = 1 and l_quantity > 45))) as r from lineitem group by 1),
p as (select p_partkey as k, coalesce(r, []) as r, case when p_size % 3 = 0 then 1990 + p_size end as first, case when p_size % 4 > 0 then 1980 + p_size end as own, p_partkey % 3 = 0 as store, case when p_partkey % 5 = 0 then 1985 + p_partkey % 20 end as stated from part left join l on k = p_partkey),
y as (select *, case when len(r) > 0 then r when first is not null then [first] when own is not null and not store then [own] else [] end as years from p)
select k, nullif(array_to_string(case when stated is not null and (len(years) = 0 or stated < years[1]) then list_prepend(stated, years) else years end, ','), '') as years from y""")  # fmt: skip
def game_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 45), F.year("l_shipdate"))).alias("r"))
    p = table(spark, sf_dir, "part").join(recorded, "p_partkey", "left")
    size, key = F.col("p_size"), F.col("p_partkey")
    years = P.game_years(F.col("r"), F.when(size % 3 == 0, 1990 + size), F.when(size % 4 > 0, 1980 + size), key % 3 == 0, F.when(key % 5 == 0, (1985 + key % 20).cast("int")))
    return p.select(key.alias("k"), F.array_join(years.cast("array<string>"), ",").alias("years"))


_SIG = "len(list_filter(string_split({k}, ' '), lambda w: w not in (" + ", ".join(f"'{w}'" for w in gate.NOISE) + ") and not regexp_matches(w, '^(19|20)\\d{{2}}$')))"


@query(f"""with {A.TITLES_SQL}, a as (select p_partkey, title_raw, i, case i when 1 then p_name when 2 then substring(p_name, 1, 3) when 3 then upper(substring(p_name, 1, 4)) || ' Classic' when 4 then 'The' else substring(p_name, 1, 7) end as alias from titles cross join range(1, 6) t(i)),
k as (select *, {A.norm_sql('alias')} as key, replace({A.norm_sql('title_raw')}, ' ', '') as own from a)
select p_partkey, string_agg(alias, '|' order by i) as aliases from k where key <> '' and not ({_SIG.format(k='key')} = 1 and length(replace(key, ' ', '')) <= 4 and length(own) >= 2 * length(replace(key, ' ', ''))) group by 1""")  # fmt: skip
def alias_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    aliases = F.array(name, F.substring(name, 1, 3), F.concat(F.upper(F.substring(name, 1, 4)), F.lit(" Classic")), F.lit("The"), F.substring(name, 1, 7))
    safe = A.titles(spark, sf_dir).select("p_partkey", gate.safe_aliases(F.col("title_raw"), aliases).alias("a")).filter("size(a) > 0")
    return safe.select("p_partkey", F.array_join("a", "|").alias("aliases"))


_LINEAGE_SQL = """g as (select p_partkey as id, [0, 8, 9, 2, 11, 10][p_size % 6 + 1] as type, case when p_partkey % 5 = 0 then p_partkey // 2 else 0 end as vp, case when p_partkey % 3 > 0 then p_partkey // 3 + 1 else 0 end as pp from part),
n as (select id, type, coalesce(nullif(vp, 0), nullif(pp, 0)) as up from g),
v(id, node, seen, d) as (select id, id, [id], 0 from n union all select v.id, n.up, list_append(seen, n.up), d + 1 from v join n on n.id = v.node where d < 4 and n.type <> 8 and n.up is not null and not list_contains(seen, n.up)),
s(id, node, seen, d) as (select id, id, [id], 0 from n union all select s.id, n.up, list_append(seen, n.up), d + 1 from s join n on n.id = s.node where d < 4 and n.type in (0, 9, 10, 11) and n.up is not null and not list_contains(seen, n.up)),
r(id, node, seen, d) as (select id, up, [up], 0 from n where type = 8 and up is not null union all select r.id, n.up, list_append(seen, n.up), d + 1 from r join n on n.id = r.node where d < 4 and n.type in (0, 9, 10, 11) and n.up is not null and not list_contains(seen, n.up))"""


@query(f"with recursive {_LINEAGE_SQL} select id, v.node as version_root, s.node as same_game_root, r.node as remake_of from (select id, arg_max(node, d) as node from v group by id) v join (select id, arg_max(node, d) as node from s group by id) s using (id) left join (select id, arg_max(node, d) as node from r group by id) r using (id)")
def game_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "array(0, 8, 9, 2, 11, 10)[p_size % 6] as type", "case when p_partkey % 5 = 0 then p_partkey div 2 else 0L end as version_parent", "case when p_partkey % 3 > 0 then p_partkey div 3 + 1 else 0L end as parent")
    return G.lineage(rows)


_ERA_NAMES = ["atari 2600", "snes", "pc", "psx", "gameboy", "unheard of", "nintendo switch", "dreamcast"]
_TOKEN = "(case lower(trim({p})) " + " ".join(f"when '{k}' then '{v}'" for k, v in E.TOKENS.items()) + " else lower(trim({p})) end)"


@query(f"""with {_CANON_SQL}, {_GEN_SQL}, eras(token, last) as (values {', '.join(f"('{E.TOKENS.get(k, k)}', {b})" for k, (_, b) in E.ERAS.items())}), names as (select unnest({_ERA_NAMES!r}) as label, unnest(range({len(_ERA_NAMES)})) as k),
info as (select k, label, last, c as canonical, gen is not null as console from (select names.*, {_TOKEN.format(p='label')} as token from names) left join eras using (token) left join canon on alias = regexp_replace(label, '[^a-z0-9]', '', 'g') left join gens using (c)),
asked as (select p_partkey as key, p_partkey % {len(_ERA_NAMES)} as k, p_partkey % 4 = 1 as two, case when p_size % 3 = 0 then 1992 + p_size % 7 end as want, p_size % 5 = 0 as uniq from part),
h as (select l_partkey as key, l_orderkey * 10 + l_linenumber as rank, l_orderkey as id, case when l_linenumber % 5 > 0 then cast(year(l_shipdate) as int) end as year, case when l_suppkey % 6 = 0 then null else l_suppkey % {len(_ERA_NAMES)} end as on_k from lineitem where l_quantity > 40),
r as (select a.key, want, uniq, coalesce(i.console, false) as console, i.last is not null or (two and false) as bound, h.id, h.rank, h.year, h.on_k is not null as stated0, coalesce(o.canonical, regexp_replace(o.label, '[^a-z0-9]', '', 'g')) = coalesce(i.canonical, regexp_replace(i.label, '[^a-z0-9]', '', 'g')) as fit0,
  h.id is not null and (h.year is null or two or not coalesce(h.year > i.last + {E.TAIL}, false)) as fine from asked a join info i using (k) left join h using (key) left join info o on o.k = h.on_k),
g as (select key, uniq, console, count(*) filter (fine and stated0) as ns, count(*) filter (fine) as no, count(*) filter (fine and coalesce(fit0, false)) as nf, count(*) filter (fine and year = want) as yo, count(*) filter (fine and coalesce(fit0, false) and year = want) as yf, min(id) filter (fine and year = want) as so, min(id) filter (fine and coalesce(fit0, false) and year = want) as sf,
  (min(case when bound then ((year is null)::int, coalesce(year, 0), rank, id) else (0, 0, rank, id) end) filter (fine))[4] as bo, (min(case when bound then ((year is null)::int, coalesce(year, 0), rank, id) else (0, 0, rank, id) end) filter (fine and coalesce(fit0, false)))[4] as bf from r group by all)
select key, case when console and nf = 0 and ns > 0 and ns = no then null when console and nf > 0 then case when nf > 1 and yf = 1 then sf when uniq and nf > 1 then null else bf end when no > 1 and yo = 1 then so when uniq and no > 1 then null else bo end as id from g""")  # fmt: skip
def era_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles: platforms by key, a second (a PC, on which nothing is too new) for a quarter of them; line items as candidates."""
    names = F.array(*map(F.lit, _ERA_NAMES))
    at = lambda c: F.get(names, (c % len(_ERA_NAMES)).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    consoles = F.when(key % 4 == 1, F.array(at(key), F.lit("pc"))).otherwise(F.array(at(key)))
    asked = table(spark, sf_dir, "part").select(key.alias("key"), consoles.alias("consoles"), at(key).alias("platform"), F.when(size % 3 == 0, 1992 + size % 7).alias("year"), (size % 5 == 0).alias("unique"))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    hits = li.select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 5 > 0, F.year("l_shipdate")).alias("year"), F.when(F.col("l_suppkey") % 6 > 0, F.array(at(F.col("l_suppkey")))).alias("platforms"))
    return I.era_picks(asked, hits)
