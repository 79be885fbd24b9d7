"""The driver's tables as a catalog's: titles with all that titles carry, source rows, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import titles as T
from tessera.sources.tables import table

# What stands before and behind a plain name, by p_partkey % 16.
DECORATIONS = (
    ("", ""), ("The ", ""), ("", ", The"), ("", " II"), ("", " (2015)"), ("", " (USA) [!].zip"), ("", ": Definitive Edition"), ("", "™ + Friends®"),
    ("", " 32X"), ("", " - Episode III"), ("A ", " & Co. Edition"), ("", " (Classic)"), ("", " Remastered"), ("", " (Hack) (Rev A) (Disc 2).iso"), ("", " HD"), ("", " (Europe) (En,Fr) (v1.1) (2001).chd"),
)
PLATFORMS = ("pc", "sega 32x", "snes", "switch", "gba")
STORES = ["N", "R"]


def pick(values, index: str):
    return F.array(*map(F.lit, values))[F.expr(index)]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, title_raw, platform, and plain columns of part."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    raw = F.concat(pick([a for a, _ in DECORATIONS], "cast(p_partkey % 16 as int)"), name, pick([b for _, b in DECORATIONS], "cast(p_partkey % 16 as int)"))
    return part.select("p_partkey", raw.alias("title_raw"), pick(PLATFORMS, "cast(p_partkey % 5 as int)").alias("platform"), "p_name", "p_brand", "p_size", "p_type")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TITLES_SQL = f"""titles as (
  select p_partkey, {_list(a for a, _ in DECORATIONS)}[p_partkey % 16 + 1] || upper(substring(p_name, 1, 1)) || substring(p_name, 2) || {_list(b for _, b in DECORATIONS)}[p_partkey % 16 + 1] as title_raw,
         {_list(PLATFORMS)}[p_partkey % 5 + 1] as platform, p_name, p_brand, p_size, p_type from part)"""


def norm_sql(title: str, platform: str | None = None) -> str:
    """titles.norm() in DuckDB's SQL."""
    q = lambda s: s.replace("'", "''")
    s = f"lower(coalesce({title}, ''))"
    for pattern, by in ((T.COMMA_ARTICLE, " "), (T.ENDING, ""), ("[™®©]", " "), (r"\((?:\s*(\d{4})\s*|[^)]*)\)", r" \1 "), (r"\[[^\]]*\]", " ")):
        s = f"regexp_replace({s}, '{q(pattern)}', '{by}', 'g')"
    s = f"regexp_replace(replace(replace({s}, '&', ' and '), '+', ' plus '), '{q(T.EDITION)}', ' ', 'g')"
    roman = " ".join(f"when '{a}' then '{b}'" for a, b in T.ROMAN.items())
    s = f"array_to_string(list_transform(list_filter(string_split(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: case w {roman} else w end), ' ')"
    s = f"regexp_replace(regexp_replace({s}, '{T.LEADING}', ''), '{T.TRAILING_EDITION}', '\\1\\2')"
    if platform:
        whens = " ".join(f"when regexp_replace(lower({platform}), '[^a-z0-9]', '', 'g') in ('{t}', '{n}') then regexp_replace({s}, '^(.+?)( {t})+$', '\\1')" for t, n in T.HARDWARE.items())
        s = f"case {whens} else {s} end"
    return s


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows of the catalog: a line item is a copy of a part in a source, owned (O) or wished for (F)."""
    # a title's key is made once for the part, below the join, and not for each of its line items
    keyed = titles(spark, sf_dir).withColumn("norm_key", T.norm(F.col("title_raw"), F.col("platform")))
    rows = table(spark, sf_dir, "lineitem").join(keyed, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        "norm_key", "platform", F.col("l_returnflag").alias("source"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("title_raw").alias("title"),
        F.col("p_brand").alias("detail"), F.when(F.col("l_linestatus") == "O", "have").otherwise("want").alias("state"),
        F.struct(F.array_position(F.array(F.lit("N"), F.lit("R"), F.lit("A")), F.col("l_returnflag")).alias("rank"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p")).alias("seq"),
    )


ROWS_SQL = f"""{TITLES_SQL},
  keyed as (select *, {norm_sql('title_raw', 'platform')} as norm_key from titles),
  src as (select norm_key, platform, l_returnflag as source, cast(l_orderkey as varchar) as source_id, title_raw as title, p_brand as detail, case l_linestatus when 'O' then 'have' else 'want' end as state,
          list_position(['N', 'R', 'A'], l_returnflag) as r, l_orderkey as k, l_linenumber as l, l_partkey as p from lineitem join keyed on l_partkey = p_partkey),
  one as (select norm_key, platform, source, source_id, case when max(case state when 'have' then 1 else 0 end) = 1 then 'have' else 'want' end as state, array_to_string(list_sort(list_distinct(list(detail))), ',') as detail,
          arg_min(title, (r, k, l, p)) as title, min((r, k, l, p)) as seq, arg_min(title, (r, k, l, p)) filter (source in ('N', 'R') and state = 'have') as store_title,
          min((r, k, l, p)) filter (source in ('N', 'R') and state = 'have') as store_seq from src group by all),
  entries as (select norm_key, platform, coalesce(arg_min(store_title, store_seq) filter (store_seq is not null), arg_min(title, seq)) as title, count(*) as n_sources, count(distinct source) as n_kinds,
          array_to_string(list_sort(list_distinct(list(source))), ',') as sources_summary, max(case state when 'have' then 1 else 0 end) as owned from one group by all)"""
