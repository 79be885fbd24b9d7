"""Asset queries: elections, templates, stand-downs and variants. Assets are line items of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import assets as M
from tessera.operators import election as E
from tessera.sources.tables import table

from .adapters import pick
from .registry import query

_KINDS = ("cover", "header", "hero", "logo", "background", "icon", "fanart")
_MEDIA_SQL = """media0 as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as id, p_name as norm_key, case when l_suppkey % 3 = 0 then '' else p_type end as system,
    ['cover', 'header', 'hero', 'logo', 'background', 'icon', 'fanart'][l_partkey % 7 + 1] as kind, l_returnflag as provider, case when l_orderkey % 10 = 0 then null else 100 + l_orderkey % 1900 end as width, case when l_orderkey % 10 = 0 then null else 100 + l_suppkey * 37 % 1200 end as height,
    case when l_tax = 0.08 then 1 when l_tax = 0.07 then 0 end as filler, cast(round(l_discount * 100) as int) as detail, case when l_orderkey % 97 = 0 then 1 end as pin, case when l_discount > 0.05 then l_partkey * 13 % 300 end as frame,
    ['us', 'eu', 'jp', ''][l_orderkey % 4 + 1] as region, l_linestatus = 'O' as matched from lineitem join part on l_partkey = p_partkey),
  media as (select *, case region when 'us' then 0 when 'eu' then 1 when '' then 2 else 3 end as region_rank from media0)"""


def provider_rank():
    return F.array_position(F.array(F.lit("N"), F.lit("A"), F.lit("R")), F.col("provider"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # an id over all rows needs one order of all rows: a range sort numbers parts of it, offsets make that one row of numbers
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    rows = numbered(li, order).join(part, F.col("l_partkey") == F.col("p_partkey"))
    known = lambda c: F.when(F.col("l_orderkey") % 10 != 0, c.cast("int"))
    rows = rows.select(
        "id", F.col("p_name").alias("norm_key"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("system"), pick(_KINDS, "cast(l_partkey % 7 as int)").alias("kind"), F.col("l_returnflag").alias("provider"),
        known(100 + F.col("l_orderkey") % 1900).alias("width"), known(100 + F.col("l_suppkey") * 37 % 1200).alias("height"), F.when(F.col("l_tax") == 0.08, 1).when(F.col("l_tax") == 0.07, 0).alias("filler"),
        F.round(F.col("l_discount") * 100).cast("int").alias("detail"), F.when(F.col("l_orderkey") % 97 == 0, 1).alias("pin"), F.when(F.col("l_discount") > 0.05, F.col("l_partkey") * 13 % 300).alias("frame"),
        pick(["us", "eu", "jp", ""], "cast(l_orderkey % 4 as int)").alias("region"), (F.col("l_linestatus") == "O").alias("matched"),
    )
    return rows.withColumn("region_rank", M.region_rank(F.col("region"), ["us", "eu"]))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `id` from 1 in the given order: buckets of the first column are numbered by themselves and shifted by prefix sums.

    The sums are taken on two levels, within blocks of 4096 buckets and over the blocks: one task sees a
    row for each block only, which is one for four million values of the first column.
    """
    rows = df.withColumn("_b", F.floor(F.col(order[0]) / 1024))
    buckets = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.floor(F.col("_b") / 4096))
    above = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = buckets.groupBy("_s").agg(F.sum("_n").alias("_n")).select("_s", above(Window.orderBy("_s")).alias("_blocks"))
    starts = buckets.withColumn("_inside", above(Window.partitionBy("_s").orderBy("_b"))).join(blocks, "_s").select("_b", (F.col("_blocks") + F.col("_inside")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_place", place).join(starts, "_b").withColumn("id", F.col("_before") + F.col("_place")).drop("_b", "_before", "_place")


_LEAST = "case kind " + " ".join(f"when '{k}' then {int(v * M.TARGET_SHARE)}" for k, v in M.TARGET_PIXELS.items()) + f" else {M.DEFAULT_PIXELS} end"
_BAND = f"case when width > 0 and height > 0 then case when width * height >= {_LEAST} then 0 else 2 end else 1 end"
_SHAPE = f"""case when width is null or height is null or kind not in ('cover', 'header', 'hero', 'background', 'icon') then true
  when kind = 'icon' then width::double / height between {1 / M.SQUARE_TOLERANCE} and {M.SQUARE_TOLERANCE}
  when width = height then true when kind = 'cover' then height > width else width > height end"""
_ELECT_SQL = f"""{_MEDIA_SQL}, tpl as (select frame, count(distinct norm_key) as titles from media where frame is not null group by 1 having count(distinct norm_key) >= 3),
  fit as (select m.*, case when t.frame is not null then 1 else 0 end as shared, {_BAND} as band, list_position(['N', 'A', 'R'], provider) as pr from media m left join tpl t using (frame) where {_SHAPE}),
  bl as (select *, count(*) over w > 1 and min(coalesce(filler, 0)) over w = 1 as blind from fit window w as (partition by norm_key, system, kind)),
  rk as (select *, row_number() over (partition by norm_key, system, kind order by coalesce(pin, 1073741824), coalesce(filler, 0), shared, region_rank, case when blind then -coalesce(detail, 0) else 0 end, band, pr, -coalesce(width * height, 0), case when matched then 0 else 1 end, id) as place from bl)"""


@query(f"with {_ELECT_SQL} select norm_key, system, kind, id, provider from rk where place = 1")
def asset_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir)
    return E.elected(m, provider_rank(), E.templates(m)).select("norm_key", "system", "kind", "id", "provider")


@query(f"with {_ELECT_SQL} select frame, titles from tpl")
def template_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.templates(media(spark, sf_dir))


@query(f"""with {_ELECT_SQL}, w as (select * from rk where place = 1), n as (select norm_key, kind, id as neutral, region from w where system = '')
select w.norm_key, w.system, w.kind, w.id, coalesce(w.system <> '' and w.pin is null and w.region = 'jp' and n.region in ('us', 'eu'), false) as yields, case when w.system <> '' and w.pin is null and w.region = 'jp' and n.region in ('us', 'eu') then neutral else w.id end as shown
from w left join n using (norm_key, kind)""")  # fmt: skip
def offlang_standdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir)
    w = E.elected(m, provider_rank(), E.templates(m))
    n = w.filter("system = ''").select("norm_key", "kind", F.col("id").alias("neutral"), F.col("region").alias("other"))
    yields = F.coalesce((F.col("system") != "") & F.col("pin").isNull() & (F.col("region") == "jp") & F.col("other").isin("us", "eu"), F.lit(False))
    rows = w.join(n, ["norm_key", "kind"], "left").withColumn("yields", yields)
    return rows.select("norm_key", "system", "kind", "id", "yields", F.when(F.col("yields"), F.col("neutral")).otherwise(F.col("id")).alias("shown"))


@query(f"""with {_ELECT_SQL} select norm_key, kind, coalesce(min(id) filter (place = 1 and system = 'PROMO'), min(id) filter (place = 1 and system = ''), min(id)) as id from rk group by all""")
def serve_pick_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir)
    rows = E.ranked(m, provider_rank(), E.templates(m))
    tier = lambda c: F.min(F.when(c, F.col("id")))
    first = F.col("place") == 1
    return rows.groupBy("norm_key", "kind").agg(F.coalesce(tier(first & (F.col("system") == "PROMO")), tier(first & (F.col("system") == "")), F.min("id")).alias("id"))


@query(f"with {_ELECT_SQL} select norm_key, kind, id, row_number() over (partition by norm_key, kind order by band, pr, -coalesce(width * height, 0), id) as shown_at from fit where kind in ('fanart', 'hero') and detail > 7")
def plural_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir)
    m = m.filter(M.shape_ok(F.col("kind"), F.col("width"), F.col("height")) & F.col("kind").isin("fanart", "hero") & (F.col("detail") > 7))
    order = [M.resolution_band(F.col("kind"), F.col("width"), F.col("height")), provider_rank(), -F.coalesce(F.col("width") * F.col("height"), F.lit(0)), F.col("id")]
    return m.select("norm_key", "kind", "id", F.row_number().over(Window.partitionBy("norm_key", "kind").orderBy(*order)).alias("shown_at"))


@query("""select l_orderkey as game, l_linenumber as disc, arg_min(l_partkey, (case l_returnflag when 'R' then 1 else 0 end, case l_linestatus when 'O' then 0 else 1 end, l_suppkey % 4, l_partkey, l_suppkey)) as variant, count(*) as variants from lineitem group by all""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.when(F.col("l_linestatus") == "O", 0).otherwise(1), F.col("l_suppkey") % 4, F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("disc")).agg(F.min_by("l_partkey", key).alias("variant"), F.count(F.lit(1)).alias("variants"))


@query("""with a as (select l_orderkey as slot, min(l_partkey) as was from lineitem where l_returnflag <> 'A' group by 1), b as (select l_orderkey as slot, min(l_partkey) as now from lineitem where l_linestatus = 'O' group by 1)
select slot, was, now, case when was is null then 'added' when now is null then 'removed' else 'moved' end as change from a full join b using (slot) where was is distinct from now""")  # fmt: skip
def election_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pick_of = lambda c: li.filter(c).groupBy(F.col("l_orderkey").alias("slot")).agg(F.min("l_partkey").alias("id"))
    return E.changes(pick_of("l_returnflag <> 'A'"), pick_of("l_linestatus = 'O'"), ["slot"], "id")


@query(f"with {_MEDIA_SQL} select id, case when width > 0 and height > 0 then case when height > width then 'portrait' when width > height then 'landscape' else 'square' end end as orientation, {_SHAPE} as fits, {_BAND} as band from media")
def asset_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, k = F.col("width"), F.col("height"), F.col("kind")
    return media(spark, sf_dir).select("id", M.orientation(w, h).alias("orientation"), M.shape_ok(k, w, h).alias("fits"), M.resolution_band(k, w, h).alias("band"))
