"""Catalog queries: titles, entries, attributes, labels, folds over source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import names as N, titles as T
from tessera.operators import catalog as C, graphs as G
from tessera.sources.tables import table, without_owned

from . import adapters as A
from .registry import query

_q = lambda s: s.replace("'", "''")


@query(f"with {A.TITLES_SQL} select p_partkey, title_raw, {A.norm_sql('title_raw')} as norm_key, {A.norm_sql('title_raw', 'platform')} as catalog_key from titles")
def norm_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.titles(spark, sf_dir)
    return t.select("p_partkey", "title_raw", T.norm(F.col("title_raw")).alias("norm_key"), T.norm(F.col("title_raw"), F.col("platform")).alias("catalog_key"))


_CUT = rf"(?i)^(.*?)[\s:–-]*(?:{'|'.join(T.MARKS)})\s*$"


@query(f"""with {A.TITLES_SQL}, c as (select *, regexp_replace(title_raw, '{_q(_CUT)}', '\\1') as cut from titles)
select p_partkey, case when length(trim(cut)) > 0 then cut else title_raw end as stripped from c""")  # fmt: skip
def strip_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.titles(spark, sf_dir).select("p_partkey", T.strip_edition(F.col("title_raw")).alias("stripped"))


@query(f"""with {A.TITLES_SQL} select p_partkey, case when regexp_matches(title_raw, '{T.STORE_YEAR}') then regexp_extract(title_raw, '{T.STORE_YEAR}', 1) else title_raw end as title,
try_cast(nullif(regexp_extract(title_raw, '{T.STORE_YEAR}', 2), '') as int) as year from titles""")  # fmt: skip
def split_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.titles(spark, sf_dir).select("p_partkey", T.store_title(F.col("title_raw")).alias("title"), T.store_year(F.col("title_raw")).alias("year"))


@query(f"""with {A.TITLES_SQL} select p_partkey, trim(regexp_extract(title_raw, '^(.*?)(:| - | – |$)', 1)) as head,
regexp_replace(regexp_replace(lower(title_raw), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from titles""")  # fmt: skip
def title_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.titles(spark, sf_dir).select("p_partkey", T.title_head(F.col("title_raw")).alias("head"), T.slug(F.col("title_raw")).alias("slug"))


@query(f"""with {A.TITLES_SQL}, k as (select p_partkey, {A.norm_sql('p_name')} as key, {A.norm_sql('title_raw')} as full_name, {A.norm_sql("'x ' || title_raw || ' y'")} as other from titles),
r as (select p_partkey, case when full_name = key then 3 when starts_with(' ' || full_name || ' ', ' ' || key || ' ') or ends_with(' ' || full_name || ' ', ' ' || key || ' ') then 2
  when contains(' ' || full_name || ' ', ' ' || key || ' ') then 1 else 0 end as a, case when contains(' ' || other || ' ', ' ' || key || ' ') then 1 else 0 end as b from k)
select p_partkey, ['norun', 'interior', 'anchored', 'exact'][a + 1] as of_title, ['norun', 'interior'][b + 1] as of_other, ['norun', 'interior', 'anchored', 'exact'][greatest(a, b) + 1] as best from r""")  # fmt: skip
def anchor_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.norm(F.col("p_name"))
    full, other = T.norm(F.col("title_raw")), T.norm(F.concat(F.lit("x "), F.col("title_raw"), F.lit(" y")))
    rows = A.titles(spark, sf_dir).select("p_partkey", key.alias("key"), full.alias("full"), other.alias("other"))
    one = lambda *c: T.anchor_class(F.col("key"), F.array(*c))
    return rows.select("p_partkey", one("full").alias("of_title"), one("other").alias("of_other"), one("full", "other").alias("best"))


def _group_sql(pattern: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(title_raw, '\\(([^()]*)\\)', 1), lambda g: regexp_matches(lower(g), '{pattern}'))[1], '')"


_R, _L = "|".join(N.REGIONS), "|".join(N.LANGUAGES)


@query(f"""with {A.TITLES_SQL} select p_partkey, trim(regexp_extract(regexp_replace(title_raw, '\\.[A-Za-z0-9]{{1,4}}$', ''), '^([^(\\[]*)', 1)) as title,
{_group_sql(f'^({_R})(, ?({_R}))*$')} as region, {_group_sql(f'^({_L})([,+] ?({_L}))*$|^m[0-9]+$')} as languages, {_group_sql('^(v[0-9]|prg[0-9]|version)')} as version,
{_group_sql('^rev([ .a-z0-9]|$)')} as revision, {_group_sql('^(disc|disk|side)( |$)')} as disc, contains(title_raw, '[!]') as verified from titles""")  # fmt: skip
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("title_raw")
    return A.titles(spark, sf_dir).select("p_partkey", *(f(n).alias(name) for name, f in (("title", N.bare_title), ("region", N.region), ("languages", N.languages), ("version", N.version), ("revision", N.revision), ("disc", N.disc), ("verified", N.verified))))


def _in(x: str, values) -> str:
    return f"{x} in (" + ", ".join(f"'{v}'" for v in values) + ")"


_KINDS = ("Translation", *N.TAGS)
_WORD = "regexp_replace(regexp_extract(g, '^([^ ,]*)', 1), '([^0-9])[0-9]+$', '\\1')"
_GROUP_KIND = f"""case when regexp_matches(g, '^t[+-][a-z]{{2,4}}$') or {_in("regexp_extract(g, '^([a-z]+) v?[. ]*[0-9]', 1)", N.TONGUES)} or starts_with(g, 'translat') then 'Translation'
  {' '.join(f"when {_in('g', tags)} or {_in(_WORD, tags)} or {_in(f"regexp_extract({_WORD}, '^([a-z]+)-', 1)", tags)} then '{kind}'" for kind, tags in N.TAGS.items())} end"""
_FLAG_KIND = "case when regexp_matches(g, '^t[+-] *[a-z]{2,4}') then 'Translation' " + " ".join(f"when regexp_extract(g, '^([a-z])[0-9]*$', 1) = '{c}' then '{k}'" for c, k in N.CODES.items()) + " end"
_RELEASE = "(with kinds as (select unnest(list_concat(list_transform(regexp_extract_all(low, '\\(([^()]*)\\)', 1), lambda g: {group}), list_transform(regexp_extract_all(low, '\\[([^\\[\\]]*)\\]', 1), lambda g: {flag}))) as kind) select arg_min(kind, {order}) from kinds where kind is not null)".replace("{group}", _GROUP_KIND).replace("{flag}", _FLAG_KIND).replace("{order}", "list_position([" + ", ".join(f"'{k}'" for k in _KINDS) + "], kind)")
_PATH = "case " + " ".join("when " + " or ".join(f"list_contains(words, '{w}')" for w in tags) + f" then '{kind}'" for kind, tags in N.FOLDERS.items()) + " end"
#: Tags that the titles of the test tables get besides their own.
_TAGGED = ["", " (Hackers)", " (Demolition)", " (HB)", " (Beta 2)", "[t1]", " [T+En]", " (French v1.1)", " (Proto-2)", " (JU)", " (USA, Canada)", " (Trade Demo)", " (19xx)"]


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.titles(spark, sf_dir).withColumn("title_raw", F.concat("title_raw", F.get(F.array(*map(F.lit, _TAGGED)), (F.col("p_partkey") % len(_TAGGED)).cast("int"))))


@query(f"""with {A.TITLES_SQL}, tagged as (select p_partkey, lower(title_raw || [{', '.join(f"'{x}'" for x in _TAGGED)}][p_partkey % {len(_TAGGED)} + 1]) as low from titles) select p_partkey, {_RELEASE} as release_type from tagged""")
def release_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("p_partkey", N.release_type(F.col("title_raw")).alias("release_type"))


@query(f"""with {A.TITLES_SQL}, tagged as (select p_partkey, title_raw || [{', '.join(f"'{x}'" for x in _TAGGED)}][p_partkey % {len(_TAGGED)} + 1] as title_raw from titles),
n as (select *, {_group_sql(f'^({_R})(, ?({_R}))*$')} as named, list_filter(regexp_extract_all(title_raw, '\\(([^()]*)\\)', 1), lambda g: regexp_matches(g, '^[{"".join(N.REGION_CODES)}]{{1,3}}$'))[1] as coded from tagged)
select p_partkey, case when named <> '' then array_to_string(string_split_regex(named, ', ?'), '+') when coded is not null then array_to_string(list_transform(string_split(coded, ''), lambda c: case c {' '.join(f"when '{k}' then '{v}'" for k, v in N.REGION_CODES.items())} end), '+') else '' end as regions,
  array_to_string(regexp_extract_all(title_raw, '\\[([^\\[\\]]*)\\]', 1), '+') as flags from n""")  # fmt: skip
def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("title_raw")
    return _tagged(spark, sf_dir).select("p_partkey", F.array_join(N.regions(name), "+").alias("regions"), F.array_join(N.flags(name), "+").alias("flags"))


@query(f"""with {A.TITLES_SQL}, low as (select *, lower(title_raw) as low, string_split_regex(regexp_replace(lower(['roms/4 Homebrew/', 'roms/', 'Translations/', 'ROM Hacks/'][p_partkey % 4 + 1] || title_raw), '(home)[ _-]+(brew)|(rom)[ _-]+(hacks)', '\\1\\2\\3\\4', 'g'), '[^a-z]+') as words from titles)
select p_partkey, {_RELEASE} as by_name, {_PATH} as by_path,
try_cast(nullif(regexp_extract(title_raw, '\\(((?:19|20)[0-9]{{2}})\\)', 1), '') as int) as year from low""")  # fmt: skip
def release_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(A.pick(["roms/4 Homebrew/", "roms/", "Translations/", "ROM Hacks/"], "cast(p_partkey % 4 as int)"), F.col("title_raw"))
    return A.titles(spark, sf_dir).select("p_partkey", N.release_type(F.col("title_raw")).alias("by_name"), N.path_type(path).alias("by_path"), N.year(F.col("title_raw")).alias("year"))


@query(f"with {A.ROWS_SQL} select * from entries")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold_sources(A.source_rows(spark, sf_dir), A.STORES)[1]


@query(f"with {A.ROWS_SQL} select norm_key, platform, source, source_id, title, detail, state from one")
def source_dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold_sources(A.source_rows(spark, sf_dir), A.STORES)[0]


@query(f"""with {A.ROWS_SQL} select norm_key, platform, sum(case source when 'N' then 1 else 0 end)::bigint as n_source_n, max(case source when 'A' then 1 else 0 end) = 1 as has_a,
string_agg(distinct source, ',' order by source) as sources, count(distinct source_id) as n_ids from one group by all""")  # fmt: skip
def entry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.fold_sources(A.source_rows(spark, sf_dir), A.STORES)[0]
    return rows.groupBy("norm_key", "platform").agg(
        F.sum(F.when(F.col("source") == "N", 1).otherwise(0)).alias("n_source_n"), F.max(F.col("source") == "A").alias("has_a"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source_id").alias("n_ids")
    )


_ATTR_SQL = """attrs as (select p_name as key, 'type' as kind, p_type as value, p_brand as provider, p_brand as rank from part union all select p_name, 'size', cast(p_size as varchar), p_brand, p_brand from part)"""


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("key"), F.col("p_brand").alias("provider"), F.explode(F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).alias("kind", "value"))


@query(f"with {_ATTR_SQL} select key, kind, value, string_agg(distinct provider, ',' order by provider) as origins from attrs group by all")
def attr_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.united(_attrs(spark, sf_dir), ["key"], "kind", "value", "provider")


@query(f"""with {_ATTR_SQL}, f as (select key, kind, arg_min(value, (provider, value)) as value from attrs group by all)
select key, kind, value, string_agg(distinct provider, ',' order by provider) as origins from attrs join f using (key, kind, value) group by all""")  # fmt: skip
def attr_union_vs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_wins(_attrs(spark, sf_dir), ["key"], "kind", "value", "provider", F.col("provider"))


@query(f"""with {_ATTR_SQL}, own as (select distinct key, kind, value from attrs where provider < 'Brand#12'), offered as (select distinct key, kind, value from attrs where provider >= 'Brand#12')
select * from own union all select * from offered o where not exists (select 1 from own w where w.key = o.key and w.kind = o.kind)""")  # fmt: skip
def attr_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attrs(spark, sf_dir)
    own, offered = (rows.filter(c).select("key", "kind", "value").distinct() for c in (F.col("provider") < "Brand#12", F.col("provider") >= "Brand#12"))
    return C.fill_gaps(own, offered, ["key", "kind"])


@query("select p_brand, count(*) filter (p_type = 'PROMO') as promo, count(*) filter (p_type = 'SMALL') as small, count(*) filter (p_type = 'LARGE') as large from part group by all")
def attr_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand").pivot("p_type", ["PROMO", "SMALL", "LARGE"]).count()
    return p.select("p_brand", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("PROMO", "SMALL", "LARGE")))


@query("""select source as system, lang as game, string_agg(distinct n_chars % 7, ',' order by n_chars % 7) as regions, count(*) as files, sum(n_chars)::bigint as bytes from documents
where source not in ('src3', 'src4') and n_chars > 0 group by all""")  # fmt: skip
def rom_scan_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(~F.col("source").isin("src3", "src4") & (F.col("n_chars") > 0))
    regions = F.array_join(F.sort_array(F.collect_set(F.col("n_chars") % 7)).cast("array<string>"), ",")
    return d.groupBy(F.col("source").alias("system"), F.col("lang").alias("game")).agg(regions.alias("regions"), F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


@query("select source as system, count(*) as files, count(distinct case when n_chars > 100 then n_chars end) as games, sum(n_chars)::bigint as bytes from documents group by all")
def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("system")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.when(F.col("n_chars") > 100, F.col("n_chars"))).alias("games"), F.sum("n_chars").alias("bytes"))


@query("""select p_partkey, case when min(n_years) over (partition by p_name) > 1 and y is not null then p_name || ' (' || y || ')' else p_name end as title from
(select p_partkey, p_name, y, m.n_years from (select p_partkey, p_name, case when p_size < 45 then 1990 + p_size // 5 end as y from part) join (select p_name, count(distinct case when p_size < 45 then p_size // 5 end) as n_years from part group by 1) m using (p_name))""")  # fmt: skip
def year_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.expr("case when p_size < 45 then 1990 + p_size div 5 end").cast("int").alias("year"))
    return C.year_labels(part, "title", "year").select("p_partkey", "title")


@query("""with e as (select p_name as norm_key, p_type as platform, p_type = 'PROMO' as is_store, max(p_size) > 48 as impossible from part group by all),
s as (select *, is_store or p_type not in ('SMALL', 'MEDIUM') as home, is_store or not impossible as fits from (select *, platform as p_type from e)),
c as (select *, sum(home::int) over w - home::int as homes, sum(fits::int) over w - fits::int as fit from s window w as (partition by norm_key))
select norm_key, platform, case when is_store then norm_key when impossible and fit > 0 then norm_key || chr(31) || platform when platform = 'SMALL' and homes > 0 then norm_key || chr(30) || platform else norm_key end as base_key from c""")  # fmt: skip
def era_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("norm_key"), F.col("p_type").alias("platform")).agg(F.max(F.col("p_type") == "PROMO").alias("is_store"), (F.max("p_size") > 48).alias("impossible"))
    return C.separate(e, ["SMALL", "MEDIUM"], ["SMALL"]).select("norm_key", "platform", "base_key")


@query("""with s as (select p_size as game_key, p_type as platform, p_name as norm_key, p_brand as source, cast(p_partkey % 3 as varchar) as source_id, p_name as title from part),
canon as (select p_size as game_key, min(p_name) as canon_key from part where p_size % 2 = 0 group by 1),
n as (select game_key, platform, norm_key, count(*) as n from s group by all),
rep as (select game_key, platform, arg_min(norm_key, (case when norm_key = canon_key then 0 else 1 end, -n, norm_key)) as rep from n left join canon using (game_key) group by all)
select distinct game_key, platform, rep as norm_key, source, source_id, title from s join rep using (game_key, platform)""")  # fmt: skip
def regional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    s = part.select(F.col("p_size").alias("game_key"), F.col("p_type").alias("platform"), F.col("p_name").alias("norm_key"), F.col("p_brand").alias("source"), (F.col("p_partkey") % 3).cast("string").alias("source_id"), F.col("p_name").alias("title"))
    canon = part.filter("p_size % 2 = 0").groupBy(F.col("p_size").alias("game_key")).agg(F.min("p_name").alias("canon_key"))
    return C.merge_regional(s, canon)


@query(f"""with {A.TITLES_SQL}, c as (select p_size as card, p_name as root, title_raw, p_partkey, regexp_replace(title_raw, '{_q(_CUT)}', '\\1') as cut from titles),
t as (select card, title_raw, case when length(trim(cut)) > 0 then cut else title_raw end as stripped, p_partkey, regexp_replace(lower(root), '[^\\p{{L}}\\p{{N}}]', '', 'g') as r, regexp_replace(lower(title_raw), '[^\\p{{L}}\\p{{N}}]', '', 'g') as a from c),
u as (select *, regexp_replace(lower(stripped), '[^\\p{{L}}\\p{{N}}]', '', 'g') as b from t),
k as (select card, p_partkey, case when a = r then 1 when stripped <> title_raw and b = r then 2 else 3 end as tier, case when a = r then title_raw when stripped <> title_raw and b = r then stripped else title_raw end as shown from u)
select card, arg_min(shown, (tier, p_partkey)) as title, min(tier) as tier from k group by card""")  # fmt: skip
def card_title_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.titles(spark, sf_dir).withColumn("stripped", T.strip_edition(F.col("title_raw")))
    plain, cut = T.same_title(F.col("title_raw"), F.col("p_name")), (F.col("stripped") != F.col("title_raw")) & T.same_title(F.col("stripped"), F.col("p_name"))
    rows = rows.select(F.col("p_size").alias("card"), "p_partkey", F.when(plain, 1).when(cut, 2).otherwise(3).alias("tier"), F.when(~plain & cut, F.col("stripped")).otherwise(F.col("title_raw")).alias("shown"))
    return rows.groupBy("card").agg(F.min_by("shown", F.struct("tier", "p_partkey")).alias("title"), F.min("tier").alias("tier"))


_FOLD_SQL = """e as (select p_partkey as id, case when p_size % 3 = 0 and p_partkey // 3 <> p_partkey then p_partkey // 3 end as parent from part)"""


@query(f"""with recursive {_FOLD_SQL}, walk(id, root, depth) as (select id, id, 0 from e union all select w.id, e.parent, w.depth + 1 from walk w join e on e.id = w.root where e.parent is not null and w.depth < 4)
select id, arg_max(root, depth) as root from walk group by id""")  # fmt: skip
def fold_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("case when p_size % 3 = 0 and p_partkey div 3 <> p_partkey then p_partkey div 3 end").alias("parent"))
    return G.fold_roots(part, part.filter("parent is not null"))


@query("""with recursive a as (select distinct p_partkey as alias, p_partkey // 2 as target from part where p_partkey > 7), walk(alias, target) as (select alias, target from a union all select w.alias, a.target from walk w join a on a.alias = w.target)
select alias, min(target) as target from walk group by alias""")  # fmt: skip
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_aliases(table(spark, sf_dir, "part").filter("p_partkey > 7").selectExpr("p_partkey as alias", "p_partkey div 2 as target"))


@query("""with l as (select p_partkey as id, p_partkey // 10 as parent from part where p_size < 10 and p_partkey >= 10)
select distinct id, kin, relation from (select id, parent as kin, 'parent' as relation from l union all select parent, id, 'child' from l union all select a.id, b.id, 'sibling' from l a join l b on a.parent = b.parent and a.id <> b.id)""")  # fmt: skip
def remake_kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "part").filter("p_size < 10 and p_partkey >= 10").selectExpr("p_partkey as id", "p_partkey div 10 as parent")
    return G.kin(table(spark, sf_dir, "part").selectExpr("p_partkey as id"), links)


@query("""with recursive t(node, anc, depth) as (select n_nationkey, 'r' || n_regionkey, 1 from nation union all select node, 'world', depth + 1 from t where depth < 2) select node, anc, depth from t""")
def recursive_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("lineage_nation")
    return spark.sql("""with recursive t(node, anc, depth) as (select n_nationkey, concat('r', n_regionkey), 1 from lineage_nation union all select node, 'world', depth + 1 from t where depth < 2) select node, anc, depth from t""")


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) as k from orders where o_orderstatus = 'P') o where k = 1 and not exists (select 1 from orders w where w.o_orderstatus = 'F' and w.o_custkey = o.o_custkey and w.o_orderpriority = '1-URGENT')")
def wishlist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    owned = o.filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_custkey")
    first = F.row_number().over(Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")) == 1
    wishes = o.filter("o_orderstatus = 'P'").withColumn("first", first).filter("first")
    return without_owned(wishes, owned, "o_custkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey")
