"""Library queries: the grid of cards, facets, statistics, search, filters and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions.titles import norm
from tessera.operators import catalog as C, search as S
from tessera.operators.candidates import alike, sharing
from tessera.sources.tables import table

from . import adapters as A
from .registry import query

# entries with a card (the title's first two words stand for the root of its ports) and a score
_ENTRIES_SQL = f"{A.ROWS_SQL}, e as (select *, split_part(norm_key, ' ', 1) || ' ' || split_part(norm_key, ' ', 2) as card, n_sources * 7 % 101 as score, platform in ('pc', 'snes') and n_sources > 5 as has_cover from entries)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.fold_sources(A.source_rows(spark, sf_dir), A.STORES)[1]
    return e.withColumns({"card": F.substring_index("norm_key", " ", 2), "score": F.col("n_sources") * 7 % 101, "has_cover": F.col("platform").isin("pc", "snes") & (F.col("n_sources") > 5)})


def best():
    return [F.col("has_cover").desc(), F.col("score").desc(), F.col("n_sources").desc(), F.col("platform"), F.col("norm_key")]


_CARDS_SQL = f"""{_ENTRIES_SQL}, c as (select card, title, norm_key, platform, score, row_number() over (partition by card order by has_cover desc, score desc, n_sources desc, platform, norm_key) as k,
  array_to_string(list_sort(list_distinct(list(platform) over (partition by card))), ',') as platforms, cast(sum(n_sources) over (partition by card) as bigint) as card_sources, count(*) over (partition by card) as n_entries from e)"""


@query(f"with {_CARDS_SQL} select card, title, platform, score, platforms, card_sources, n_entries from c where k = 1 order by lower(title), card limit 20")
def card_grid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.cards(entries(spark, sf_dir), "card", best(), ["title", "platform", "score"])
    return S.page(rows, [F.lower("title"), F.col("card")], 20)


@query(f"with {_CARDS_SQL} select card, title, n_entries from c where k = 1 order by card_sources desc, card limit 10 offset 5")
def paging_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.cards(entries(spark, sf_dir), "card", best(), ["title"])
    return S.page(rows, [F.col("card_sources").desc(), F.col("card")], 10, 5).select("card", "title", "n_entries")


@query("select o_orderkey, o_custkey from orders where o_orderkey > 5000 order by o_orderkey limit 500")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5000, 500)


@query(f"with {_ENTRIES_SQL} select 'platform' as facet, platform as value, count(distinct card) as cards, count(*) as entries from e group by platform union all select 'owned', cast(owned as varchar), count(distinct card), count(*) from e group by owned")
def card_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("platform").alias("facet"), F.col("platform").alias("value")), F.struct(F.lit("owned").alias("facet"), F.col("owned").cast("string").alias("value")))
    rows = entries(spark, sf_dir).select("card", F.inline(pairs))
    return rows.groupBy("facet", "value").agg(F.countDistinct("card").alias("cards"), F.count(F.lit(1)).alias("entries"))


@query(f"with {_ENTRIES_SQL} select count(*) as entries, count(distinct card) as cards, count(*) filter (owned = 0) as wanted, count(*) filter (n_kinds > 1) as cross_source, count(*) filter (not has_cover) as no_media, count(*) filter (score < 60) as low from e")
def card_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.count(F.when(c, 1))
    return entries(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("card").alias("cards"), number(F.col("owned") == 0).alias("wanted"), number(F.col("n_kinds") > 1).alias("cross_source"), number(~F.col("has_cover")).alias("no_media"), number(F.col("score") < 60).alias("low")
    )


@query(f"with {_ENTRIES_SQL}, r as (select card, norm_key, title, score, row_number() over w as k, count(*) over (partition by card) as n_platforms from e where has_cover window w as (partition by card order by score desc, title, platform, norm_key)) select card, norm_key, title, score, n_platforms from r where k = 1 and n_platforms > 1")
def spotlight_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("card")
    rows = entries(spark, sf_dir).filter("has_cover").withColumns({"k": F.row_number().over(w.orderBy(F.col("score").desc(), "title", "platform", "norm_key")), "n_platforms": F.count(F.lit(1)).over(w)})
    return rows.filter("k = 1 and n_platforms > 1").select("card", "norm_key", "title", "score", "n_platforms")


@query(f"with {A.TITLES_SQL} select p_partkey, title_raw from titles where contains(lower(title_raw), '& co.') or contains(lower(title_raw), '%') or contains(lower(title_raw), '[!]')")
def search_literal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title_raw")
    return A.titles(spark, sf_dir).filter(S.contains(t, "& Co.") | S.contains(t, "%") | S.contains(t, "[!]")).select("p_partkey", "title_raw")


@query(f"with {A.TITLES_SQL} select p_partkey from titles where contains(lower(title_raw), 'gear') and contains(lower(platform), 's') and not contains(lower(title_raw), 'hack') and p_size > 20 and not contains(lower(title_raw), 'nofield:x')")
def search_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.parse("Gear platform:S -hack size:>20 -nofield:x", F.col("title_raw"), {"platform": F.col("platform")}, {"size": F.col("p_size")})
    return A.titles(spark, sf_dir).filter(held).select("p_partkey")


@query(f"with {_ENTRIES_SQL} select norm_key, platform from e where has_cover and contains(sources_summary, 'N') and n_kinds > 1 and not (platform = 'snes') and not (owned = 0)")
def filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.Filters(
        {"has_cover": F.col("has_cover"), "cross_source": F.col("n_kinds") > 1, "wanted": F.col("owned") == 0},
        {"source": lambda x: F.array_contains(F.split("sources_summary", ","), x), "system": lambda x: F.col("platform") == x},
    )
    return entries(spark, sf_dir).filter(f.all(["has_cover", "source:N", "cross_source"], ["system:snes", "wanted"], needed=True)).select("norm_key", "platform")


@query("""select p_partkey, coalesce(case when p_partkey % 11 = 0 then true when p_partkey % 13 = 0 then false end, p_type = 'PROMO' or contains(p_name, 'gizmo')) as hidden from part""")
def nongame_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("p_partkey") % 11 == 0, "hide").when(F.col("p_partkey") % 13 == 0, "show")
    return table(spark, sf_dir, "part").select("p_partkey", S.hidden(override, F.col("p_type") == "PROMO", F.contains("p_name", F.lit("gizmo"))).alias("hidden"))


@query(f"with {A.TITLES_SQL}, k as (select p_partkey, platform, p_brand, {A.norm_sql('title_raw')} as key from titles), t as (select distinct p_partkey, platform, p_brand, key, unnest(string_split(key, ' ')) as tok from k) "
       "select a.p_partkey as a, b.p_partkey as b, count(*) as shared from t a join t b on a.tok = b.tok and a.platform = b.platform and a.p_brand = b.p_brand and a.key < b.key group by all having count(*) >= 2")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of one platform and brand whose keys differ and share two words or more."""
    return sharing(A.titles(spark, sf_dir), "p_partkey", ["platform", "p_brand"], norm(F.col("title_raw")), 2)


@query(f"""with {A.TITLES_SQL}, k as (select platform, p_brand, {A.norm_sql('title_raw')} as key, p_partkey from titles), g as (select platform, p_brand, key, min(p_partkey) as id, count(*) as rows, list_distinct(list_filter(string_split(key, ' '), lambda w: w <> '')) as words from k group by all),
t as (select *, unnest(words) as tok from g), p as (select a.id as a, b.id as b, a.rows as rows_a, b.rows as rows_b, len(a.words) as n, len(b.words) as m, count(*) as shared from t a join t b on a.tok = b.tok and a.platform = b.platform and a.p_brand = b.p_brand and a.key < b.key group by all)
select a, b, rows_a, rows_b, shared from p where shared * 100 >= (n + m - shared) * 50""")  # fmt: skip
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one platform and brand that share half of their words or more, by their smallest parts; rows of one key are no pair."""
    return alike(A.titles(spark, sf_dir), "p_partkey", ["platform", "p_brand"], norm(F.col("title_raw")), 50)


def _grid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.withColumns({"sources": F.split("sources_summary", ","), "kinds": F.when(F.col("has_cover"), F.array(F.lit("cover"))).otherwise(F.array().cast("array<string>")), "identified": F.col("n_sources") % 3 > 0, "utility": F.col("n_sources") % 7 == 0})


_ASKED = dict(q="e", query="score:>20 -platform:gba", source="N", include=["cross_source"], exclude=["hidden"], status="owned", identified="identified")


def _filters() -> S.Filters:
    return S.Filters({"cross_source": F.col("n_kinds") > 1, "hidden": F.col("score") > 95}, {})


_ASKED_SQL = f"""{_ENTRIES_SQL}, asked as (select * from e where contains(lower(title), 'e') and score > 20 and not contains(platform, 'gba') and list_contains(string_split(sources_summary, ','), 'N')
  and n_kinds > 1 and not score > 95 and owned = 1 and n_sources % 3 > 0 and n_sources % 7 <> 0)"""


@query(f"with {_ASKED_SQL} select norm_key, platform, title, n_sources, score from asked order by n_sources desc, lower(title), norm_key, platform limit 50 offset 10")
def grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.grid(_grid_entries(spark, sf_dir), _filters(), sort=["-n_sources", "title"], limit=50, offset=10, **_ASKED)
    return rows.select("norm_key", "platform", "title", "n_sources", "score")


@query(f"with {_ASKED_SQL} select count(*) as total from asked")
def grid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matching(_grid_entries(spark, sf_dir), _filters(), **_ASKED).agg(F.count(F.lit(1)).alias("total"))


@query(f"with {_ENTRIES_SQL}, s as (select *, case when n_sources % 3 > 0 then 'identified' else 'unidentified' end as i, case when n_sources % 7 = 0 then 'utilities' when owned = 1 then 'owned' else 'wanted' end as s from e) select s as status, i as identified, count(*) as n from s group by s, i")
def status_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid_entries(spark, sf_dir)
    one = lambda s, i: S.matching(rows, _filters(), status=s, identified=i).select(F.lit(s).alias("status"), F.lit(i).alias("identified"))
    parts = [one(s, i) for s in ("owned", "wanted", "utilities") for i in ("identified", "unidentified")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("status", "identified").agg(F.count(F.lit(1)).alias("n"))
