"""Identity queries: the handle index, layered look-ups, gates and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import eras as E, gate, titles as T
from tessera.operators import identity as I
from tessera.operators.candidates import best_accepted, judged_pairs
from tessera.sources.tables import table

from . import adapters as A
from .registry import query

_KEYS_SQL = """keys as (select 'cust' as ns, cast(c_custkey as varchar) as val, c_custkey as identity_id from customer union all select 'name', lower(c_name), c_custkey from customer
  union all select 'order', cast(o_orderkey as varchar), o_custkey from orders)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parts = [(c, "cust", F.col("c_custkey").cast("string"), "c_custkey"), (c, "name", F.lower("c_name"), "c_custkey"), (o, "order", F.col("o_orderkey").cast("string"), "o_custkey")]
    out = None
    for frame, ns, val, of in parts:
        one = frame.select(F.lit(ns).alias("ns"), val.alias("val"), F.col(of).alias("identity_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {_KEYS_SQL}, asked as (select 'order' as ns, cast(o_orderkey as varchar) as val from orders where o_orderpriority = '1-URGENT')
select a.ns as asked_ns, a.val as asked_val, k.identity_id, s.ns, s.val from asked a join keys k using (ns, val) join keys s on s.identity_id = k.identity_id""")  # fmt: skip
def identity_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("ns"), F.col("o_orderkey").cast("string").alias("val"))
    return I.siblings(_keys(spark, sf_dir), asked)


@query("""with asked as (select 'order' as ns, cast(o_orderkey as varchar) as val, o_orderkey as k, o_custkey as c from orders)
select ns, val, case when k % 7 = 0 then case when k % 14 = 0 then null else c + 1 end when k % 3 = 0 then c + 1000 when k % 2 = 0 then c end as identity_id,
case when k % 7 = 0 then 'override' when k % 3 = 0 then 'learned' when k % 2 = 0 then 'index' end as layer from asked""")  # fmt: skip
def layered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("ns"), F.col("o_orderkey").cast("string").alias("val"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    layer = lambda when, who: o.filter(when).select("ns", "val", F.expr(who).alias("identity_id"))
    layers = [("override", layer("k % 7 = 0", "case when k % 14 = 0 then null else c + 1 end")), ("learned", layer("k % 3 = 0", "c + 1000")), ("index", layer("k % 2 = 0", "c"))]
    return I.layered(o.select("ns", "val"), layers)


@query("""with f as (select o_orderkey as id, sha1(cast(o_custkey as varchar)) as sha1, cast(o_orderkey % 1000 as varchar) as crc from orders),
s as (select sha1(cast(c_custkey as varchar)) as sha1, c_custkey as by_sha from customer where c_custkey % 2 = 0), c as (select cast(s_suppkey as varchar) as crc, s_suppkey as by_crc from supplier)
select id, coalesce(by_sha, by_crc) as identity_id, case when by_sha is not null then 'sha1' when by_crc is not null then 'crc' end as evidence from f left join s using (sha1) left join c using (crc)""")  # fmt: skip
def hash_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha1(F.col("o_custkey").cast("string")).alias("sha1"), (F.col("o_orderkey") % 1000).cast("string").alias("crc"))
    s = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.sha1(F.col("c_custkey").cast("string")).alias("sha1"), F.col("c_custkey").alias("by_sha"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("crc"), F.col("s_suppkey").alias("by_crc"))
    return f.join(s, "sha1", "left").join(c, "crc", "left").select("id", F.coalesce("by_sha", "by_crc").alias("identity_id"), F.when(F.col("by_sha").isNotNull(), "sha1").when(F.col("by_crc").isNotNull(), "crc").alias("evidence"))


_NOISE = ", ".join(f"'{w}'" for w in gate.NOISE)
_VALUE = "case when regexp_matches({w}, '^\\d{{1,2}}$') then cast({w} as int) " + " ".join(f"when {{w}} = '{a}' then {b}" for a, b in gate.NUMERALS.items()) + " end"


def _value(w: str) -> str:
    return _VALUE.format(w=w)


def _values(words: str) -> str:
    return f"list_filter(list_transform({words}, lambda w: {_value('w')}), lambda v: v is not null)"


def gate_sql(pairs: str, owned: str, candidate: str) -> str:
    """CTEs q1 to q3 over the rows of `pairs`; q3 adds ok and score as gate.judged() without years has them."""
    sub = lambda t: f"case when contains({t}, ':') then regexp_extract({t}, '(?s)^[^:]*:(.*)$', 1) when contains({t}, ' - ') then regexp_extract({t}, '(?s)^.*? - (.*)$', 1) else regexp_extract({t}, '(?s)^.*? – (.*)$', 1) end"
    toks = lambda k: f"list_distinct(list_filter(string_split({k}, ' '), lambda w: w <> ''))"
    sig = lambda k: f"list_filter({k}, lambda w: w not in ({_NOISE}) and not regexp_matches(w, '^(19|20)\\d{{2}}$'))"
    has = lambda x, y: f"len(list_filter({x}, lambda w: not list_contains({y}, w)))"
    return f"""q0 as (select *, {A.norm_sql(owned)} as qn, {A.norm_sql(candidate)} as cn, {A.norm_sql(sub(owned))} as qs, {A.norm_sql(sub(candidate))} as cs from {pairs}),
  q1 as (select *, {toks('qn')} as qt, {toks('cn')} as ct, {sig(toks('qs'))} as qsub, {sig(toks('cs'))} as csub from q0),
  q2 as (select *, {sig('qt')} as qsig, {sig('ct')} as csig, {_values('ct')} as cvals, {_values('qt')} as qvals, {_values('list_filter(ct, lambda w: not list_contains(qt, w))')} as extra,
    replace(qn, ' ', '') = replace(cn, ' ', '') as squashed, list_filter({sig('qt')}, lambda w: not list_contains({sig('ct')}, w)) as qonly, list_filter({sig('ct')}, lambda w: not list_contains({sig('qt')}, w)) as conly from q1),
  q25 as (select *, len(qonly) + len(conly) > 0 and len({_values('qonly')}) = len(qonly) and len({_values('conly')}) = len(conly) and (len(qonly) = 0 or len(conly) = 0) and len(qsub) > 0 and list_sort(qsub) = list_sort(csub) as variant,
    len(qsig) > 0 and len(list_filter(qsig, lambda w: not (list_contains(ct, w) or coalesce(list_contains(cvals, {_value('w')}), false)))) = 0 as covered from q2),
  q3 as (select *, squashed or ((covered or variant) and not (not variant and len(extra) > 0 and not list_contains(extra, 1) and len(qvals) = 0)) as ok,
    case when squashed then 2.0::double else (len(qt) - {has('qt', 'ct')})::double / len(qt) + (len(qt) - {has('qt', 'ct')})::double / len(ct) end as score from q25 where len(qt) > 0 and len(ct) > 0)"""


@query(f"""with {A.TITLES_SQL}, pairs as (select a.p_partkey as a, b.p_partkey as b, a.title_raw as t, b.title_raw as u from titles a join titles b on a.p_brand = b.p_brand and a.p_size = b.p_size),
{gate_sql('pairs', 't', 'u')} select a, b, ok, cast(round(score * 1000000) as bigint) as score from q3""")  # fmt: skip
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of every title and every other of its brand and size, refusals too."""
    return judged_pairs(A.titles(spark, sf_dir), "p_partkey", ["p_brand", "p_size"], F.col("title_raw"), lambda score: F.round(score * 1000000).cast("long"))


@query(f"""with {A.TITLES_SQL}, pairs as (select a.p_partkey as a, b.p_partkey as b, a.title_raw as t, b.title_raw as u from titles a join titles b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey <> b.p_partkey),
{gate_sql('pairs', 't', 'u')} select a, -max((score, -b))[2] as b, cast(round(max((score, -b))[1] * 1000000) as bigint) as score from q3 where ok group by a""")  # fmt: skip
def gate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best that the gate accepts for each title among the others of its brand and size."""
    best = best_accepted(A.titles(spark, sf_dir), "p_partkey", ["p_brand", "p_size"], F.col("title_raw"))
    return best.select("a", "b", F.round(F.col("score") * 1000000).cast("long").alias("score"))


@query(f"""with {A.TITLES_SQL}, pairs as (select a.p_partkey as a, b.p_partkey as b, a.title_raw as t, b.title_raw as u from titles a join titles b on a.p_name = b.p_name and a.p_partkey % 2 = 0 and b.p_partkey % 2 = 1 and a.p_brand = b.p_brand),
{gate_sql('pairs', 't', 'u')} select a, -max((score, -b))[2] as b, cast(round(max((score, -b))[1] * 1000000) as bigint) as score from q3 where ok group by a""")  # fmt: skip
def gated_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.titles(spark, sf_dir).dropna(subset=["p_name", "p_brand"]).withColumn("block", F.struct("p_name", "p_brand"))
    owned = t.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), "title_raw", "block")
    candidates = t.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), "title_raw", "block")
    best = I.gated_kinds(owned, candidates, "block", "title_raw", gate.features, gate.judged_features, "a", "b")
    return best.select("a", "b", F.round(F.col("score") * 1000000).cast("long").alias("score"))


@query("""with c as (select o_custkey as k, year(o_orderdate) as y, o_orderkey as id from orders), w as (select c_custkey as k, 1993 + c_custkey % 6 as want from customer)
select k, case when count(*) = 1 then min(id) end as id, count(*) as n from w join c using (k) where y = want group by k""")  # fmt: skip
def pick_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("id"))
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.lit(1993) + F.col("c_custkey") % 6).alias("want"))
    return w.join(c, "k").filter("y = want").groupBy("k").agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("id"), F.count(F.lit(1)).alias("n"))


@query("""with b as (select p_name as key, p_size * 31 + p_partkey % 3 as value from part), n as (select value, count(distinct key) as claims from b group by 1) select distinct key, value, claims, claims = 1 as kept from b join n using (value)""")
def many_to_one_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), (F.col("p_size") * 31 + F.col("p_partkey") % 3).alias("value"))
    kept, refused = I.refuse_shared(b, "value", "key")
    return kept.withColumns({"claims": F.lit(1).cast("long"), "kept": F.lit(True)}).unionByName(refused.withColumn("kept", F.lit(False))).distinct()


@query("select c_custkey as key, case when row_number() over w = 1 then c_nationkey * 100 + c_custkey % 40 end as value, case when row_number() over w = 1 then 'found' else 'collision' end as status from customer window w as (partition by c_nationkey * 100 + c_custkey % 40 order by c_custkey)")
def collision_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") * 100 + F.col("c_custkey") % 40).alias("value"))
    return I.guard_collisions(w, "key", "value", F.col("key"))


@query("select s_suppkey as id, lower(s_name) as key, coalesce(i, s_suppkey + 100000000) as identity_id, i is null as minted from supplier left join (select lower(replace(c_name, 'Customer', 'Supplier')) as k, c_custkey as i from customer where c_custkey % 3 = 0) on k = lower(s_name)")
def id_minting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("key"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.lower(F.regexp_replace("c_name", "Customer", "Supplier")).alias("key"), F.col("c_custkey").alias("identity_id"))
    return I.mint(rows, known, "key", 100_000_000)


@query("select l_orderkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as l_suppkey, case when count(distinct l_suppkey) = 1 then 'resolved' else 'conflict' end as status from lineitem group by 1")
def hash_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unique_or_conflict(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("select o_orderkey, l_linenumber, l_suppkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey and year(l_shipdate) between year(o_orderdate) - 1 and year(o_orderdate) + 1 group by all")
def era_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    year = F.year("o_orderdate")
    rows = o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & F.year("l_shipdate").between(year - 1, year + 1))
    return rows.groupBy("o_orderkey", "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select p_partkey, ['manual', 'store_id', 'era', 'name', 'judged_name', 'other'][p_partkey % 6 + 1] as m, ['exact', 'anchored', 'interior', 'norun'][p_size % 4 + 1] as a, p_partkey % 5 > 0 as listed, p_partkey % 10 = 0 as imp from part),
s as (select *, m in ('era', 'name', 'judged_name') as t from m)
select p_partkey, cast(case when m = 'manual' then 100 else greatest(0, least(100, case m when 'store_id' then 96 when 'era' then 88 when 'name' then 85 when 'judged_name' then 72 else 65 end
+ case when t then case a when 'exact' then 0 when 'anchored' then -12 when 'interior' then -50 else -45 end else 0 end + case when t and not listed then case when imp then -42 else -22 end else 0 end)) end as int) as confidence,
case when m = 'manual' then 'pinned by hand' else coalesce(nullif(concat_ws('; ', case when t and a in ('interior', 'norun') then a || ' title match' end, case when t and not listed then case when imp then 'platform impossible for this game''s era' else 'platform not listed' end end), ''),
case m when 'store_id' then 'matched by store ID' when 'name' then 'exact title match' else 'matched' end) end as reason from s""")  # fmt: skip
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, a = A.pick(["manual", "store_id", "era", "name", "judged_name", "other"], "cast(p_partkey % 6 as int)"), A.pick(["exact", "anchored", "interior", "norun"], "p_size % 4")
    args = (F.col("m"), F.col("a"), F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 10 == 0)
    rows = table(spark, sf_dir, "part").withColumns({"m": m, "a": a})
    return rows.select("p_partkey", gate.confidence(*args).alias("confidence"), gate.confidence_reason(*args).alias("reason"))


@query("""with e as (select o_orderkey as id, o_custkey % 9 as entry, o_orderpriority as platform from orders), fit as (select e.id, count(*) filter (c.platform = e.platform) as fits, min(c.cand) filter (c.platform = e.platform) as one, min(c.gen) as gen, any_value(e.id % 6) as own
from e join (select distinct s_suppkey as cand, s_nationkey % 9 as entry, ['1-URGENT', '2-HIGH', '3-MEDIUM'][s_suppkey % 3 + 1] as platform, s_suppkey % 5 as gen from supplier) c using (entry) group by e.id)
select id, case when fits = 1 then 'unique' when fits > 1 then 'ambiguous' when own < gen then 'none_impossible' else 'none_uncertain' end as kind, case when fits = 1 then one end as identity_id from fit""")  # fmt: skip
def per_entry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("entry"), F.col("o_orderpriority").alias("platform"))
    on = A.pick(["1-URGENT", "2-HIGH", "3-MEDIUM"], "cast(s_suppkey % 3 as int)")
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cand"), (F.col("s_nationkey") % 9).cast("long").alias("entry"), on.alias("platform"), (F.col("s_suppkey") % 5).alias("gen"))
    kind = F.when(F.col("fits") == 1, "unique").when(F.col("fits") > 1, "ambiguous").when(F.col("id") % 6 < F.col("gen"), "none_impossible").otherwise("none_uncertain")
    return I.fits_of_entry(e, c).select("id", kind.alias("kind"), F.when(F.col("fits") == 1, F.col("one")).alias("identity_id"))


@query("select p_partkey, p_brand from part p where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 48) or p_size > 45")
def exists_or_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, sf_dir, "part").join(hit, "p_partkey", "left").filter("hit or p_size > 45").select("p_partkey", "p_brand")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def owned_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, count(distinct o_orderpriority) as kinds from customer left join orders on o_custkey = c_custkey group by 1 having count(distinct o_orderpriority) < 4")
def missing_kinds_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds")).filter("kinds < 4")


# platforms of parts and of what they are matched with, from both tables' labels and canonical names
_LABELS = sorted({*E.ERAS, *E.GENERATIONS, "pc", "unheard of"})
_TOKEN_SQL = "(case trim(lower({p})) " + " ".join(f"when '{k}' then '{v}'" for k, v in E.TOKENS.items()) + " else trim(lower({p})) end)"
_ERA_SQL = f"""eras(token, first, last) as (values {', '.join(f"('{E.TOKENS.get(k, k)}', {a}, {b})" for k, (a, b) in E.ERAS.items())}),
gens(token, gen) as (values {', '.join(f"('{k}', {v})" for k, v in E.GENERATIONS.items())}),
labels as (select unnest([{', '.join(f"'{x}'" for x in _LABELS)}]) as label, unnest(range({len(_LABELS)})) as k),
p as (select p_partkey as id, l.label, case when p_size % 9 <> 0 then 1975 + p_partkey % 60 end as year from part join labels l on l.k = p_partkey % {len(_LABELS)}),
t as (select id, label, year, {_TOKEN_SQL.format(p='label')} as token from p)"""


def _era_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, _LABELS))
    at = lambda c: F.get(labels, (c % len(_LABELS)).cast("int"))
    key = F.col("p_partkey")
    theirs = F.when(key % 11 != 0, F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: at(key + i * 7)))
    return table(spark, sf_dir, "part").select(key.alias("id"), at(key).alias("label"), F.when(F.col("p_size") % 9 != 0, 1975 + key % 60).cast("int").alias("year"), theirs.alias("theirs"))


@query(f"with {_ERA_SQL} select id, label, year, first, last, coalesce(year > last + {E.TAIL}, false) as impossible from t left join eras using (token)")
def era_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return _era_parts(spark, sf_dir).select("id", "label", "year", E.first_year(label).alias("first"), E.last_year(label).alias("last"), E.impossible(label, F.col("year")).alias("impossible"))


@query(f"""with {_ERA_SQL}, x as (select t.id, unnest(range(1, t.id % 3 + 2)) as i from t where t.id % 11 <> 0),
y as (select x.id, {_TOKEN_SQL.format(p='l.label')} as token from x join labels l on l.k = (x.id + x.i * 7) % {len(_LABELS)}),
z as (select y.id, min(gen) as earliest, list(token) as tokens from y left join gens using (token) group by y.id)
select t.id, g.gen as generation, coalesce(not list_contains(z.tokens, t.token) and g.gen < z.earliest, false) as suspect, z.tokens is null or list_contains(z.tokens, t.token) as hardware_ok from t left join gens g using (token) left join z using (id)""")  # fmt: skip
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, theirs = F.col("label"), F.col("theirs")
    return _era_parts(spark, sf_dir).select("id", E.generation(label).alias("generation"), E.contamination_suspect(label, theirs).alias("suspect"), E.hardware_ok(F.array(label), theirs).alias("hardware_ok"))


@query(f"""with {_ERA_SQL}, c as (select l_partkey as id, case when l_linenumber % 4 <> 0 then year(l_shipdate) end as year, l_orderkey * 10 + l_linenumber as rank from lineitem),
g as (select t.id, coalesce(e.last < 9999, false) as bound, arg_min(rank, (c.year, c.rank)) filter (c.year is not null) as earliest, min(rank) as first from t join c using (id) left join eras e using (token) group by all)
select id, case when bound and earliest is not null then earliest else first end as picked from g""")  # fmt: skip
def era_aware_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.struct(F.when(F.col("l_linenumber") % 4 != 0, F.year("l_shipdate")).alias("year"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank")).alias("c"))
    # the candidates of a part that can be picked are two: the earliest dated and the first; no list of all is made
    best = c.groupBy("id").agg(F.array_compact(F.array(F.min(F.when(F.col("c.year").isNotNull(), F.col("c"))), F.min_by("c", "c.rank"))).alias("cs"))
    return _era_parts(spark, sf_dir).join(best, "id").select("id", E.era_aware_pick(F.col("cs"), F.col("label"))["rank"].alias("picked"))


@query("""with b as (select distinct 'k' || p_partkey % 900 as norm_key, p_partkey % 900 // 2 % 200 as identity_id from part), s as (select 'k' || l_partkey % 900 as norm_key, case l_linenumber % 4 when 0 then 'emulation' else l_returnflag end as source, case when l_suppkey % 6 > 0 then cast(l_suppkey % 12 as varchar) else '' end as source_id from lineitem where l_quantity > 49),
t as (select s_suppkey as identity_id, s_nationkey % 15 as type from supplier), x as (select b.*, coalesce(type in (3, 13), false) as bundle from b left join t using (identity_id)),
r as (select norm_key, identity_id, source, source_id from x join s using (norm_key) where not bundle and source <> 'emulation' and source_id <> ''),
m as (select identity_id, source from r group by all having count(distinct norm_key) > 1 and count(distinct source_id) > 1)
select norm_key, identity_id, 'compilation' as why from x where bundle union all select distinct norm_key, identity_id, 'many_to_one' from r join m using (identity_id, source)""")  # fmt: skip
def identity_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("k"), (F.col(c) % 900).cast("string")).alias("norm_key")
    bindings = table(spark, sf_dir, "part").select(name("p_partkey"), F.expr("p_partkey % 900 div 2 % 200").alias("identity_id")).distinct()
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    sources = li.select(name("l_partkey"), F.when(F.col("l_linenumber") % 4 == 0, "emulation").otherwise(F.col("l_returnflag")).alias("source"), F.when(F.col("l_suppkey") % 6 > 0, (F.col("l_suppkey") % 12).cast("string")).otherwise("").alias("source_id"))
    types = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("identity_id"), (F.col("s_nationkey") % 15).alias("type"))
    return I.refused_identities(bindings, sources, types)
