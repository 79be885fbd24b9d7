"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, exact_dedup, licenses, ngram_join, packing, phrases, pieces, quality, sharding, substring, token_files, toxicity, url_filter
from .common import documents

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 24


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.repeated_words(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(documents(spark, sf_dir))
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return book.select(F.col("row.doc_id").alias("doc_id"), *measured, (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), size=3, percent=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer(BPE), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.read(token_files.write(documents(spark, sf_dir), tokenizer(BPE), end_id=2))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(documents(spark, sf_dir)).select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def op8_license_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def op8_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_wrapped(documents(spark, sf_dir)).select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(documents(spark, sf_dir), tokenizer(PIECES))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARDS)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), support=10, longest=3, inside_percent=50, top=2000)


CENTROIDS, ROUNDS, DIMS, SEED = 40, 5, 64, 2


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return centroids.summary(spark, centroids.lloyd(vectors, CENTROIDS, ROUNDS, DIMS, seed=SEED))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_ngram_jaccard, op4_packing, op5_exact_dedup, op6_token_files, op7_url_filter, op8_license_scan, op8_license_scan_lines, op8_license_scan_wrapped, op9_sentencepiece, op10_sharding, op11_phrases, op12_centroids, op13_toxicity)}
ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op1_substring_dedup"] = f"""
with w as (select doc_id, unnest(words) as x, generate_subscripts(words, 1) as i, len(words) as n from (select doc_id, {_WORDS} as words from documents)),
     win as (select doc_id, i, x, case when i + 19 <= n then array_to_string(list(x) over (partition by doc_id order by i rows between current row and 19 following), ' ') end as t from w),
     dup as (select doc_id, i, x, t is not null and row_number() over (partition by t order by doc_id, i) > 1 as d from win),
     gone as (select doc_id, i, x, max(cast(d as int)) over (partition by doc_id order by i rows between 19 preceding and current row) = 1 as g from dup),
     k as (select doc_id, count(*) as n_words, count(*) filter (g) as n_removed, coalesce(string_agg(x, ' ' order by i) filter (not g), '') as kept from gone group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join k using (doc_id)"""

ORACLES["op2_quality_rules"] = rf"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS} as words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
     each as (select doc_id, unnest(words) as x, generate_subscripts(words, 1) as i from w),
     win as (select doc_id, i, x, lead(x) over t as y, lead(x, 2) over t as z from each window t as (partition by doc_id order by i)),
     grams as (select doc_id, i, count(*) over (partition by doc_id, x, y, z) as c from win where z is not null),
     covered as (select distinct doc_id, i + unnest([0, 1, 2]) as i from grams where c > 1),
     rep as (select doc_id, count(*) as n from covered group by doc_id),
     m as (select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
                  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
                  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
                  cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join rep using (doc_id)),
     j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > word_chars or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 25 * n_words) as kept
from j"""

ORACLES["op3_ngram_jaccard"] = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
     each as (select doc_id, unnest(words) as x, generate_subscripts(words, 1) as i, len(words) as n from w),
     run as (select doc_id, i, n, x, lead(x) over t as y, lead(x, 2) over t as z from each window t as (partition by doc_id order by i)),
     sets as (select distinct doc_id, case when z is not null then x || ' ' || y || ' ' || z else x || coalesce(' ' || y, '') end as s from run where z is not null or (i = 1 and n < 3)),
     size as (select doc_id, count(*) as n from sets group by doc_id),
     meet as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
     link as (select a, b from meet join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
     both_ways as (select a, b from link union all select b, a from link),
     reach as (select doc_id, doc_id as c from documents union select r.doc_id, b.b from reach r join both_ways b on b.a = r.c)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(c) as component_id from documents d join reach using (doc_id) left join size using (doc_id) group by d.doc_id"""

ORACLES["op5_exact_dedup"] = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)"""


def _url_sql() -> str:
    term = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r.rule), r.rule))
    fits = [(f"((host = '{r.host}' or suffix(host, '.{r.host}')) and prefix(path, '{r.path}'))", r) for r in rules]
    strict, soft = " or ".join(map(term, url_filter.STRICT)), " + ".join(f"cast({term(t)} as int)" for t in url_filter.SOFT)
    return f"""
with p as (select page_id, lower(coalesce(url, '')) as low, position('://' in coalesce(url, '')) as cut, coalesce(url, '') as url from pages),
     r as (select page_id, low, case when cut > 0 then substring(url, cut + 3) else '' end as rest from p),
     h as (select page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, case {" ".join(f"when {w} then '{r.rule}'" for w, r in fits)} end as rule,
       case {" ".join(f"when {w} then '{r.verdict}'" for w, r in fits)} when {strict} then 'block' when {soft} >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end as verdict
from h"""


def _license_sql() -> str:
    known = ", ".join(f"('{text}', '{name}')" for name, text in licenses.SENTENCES.items())
    # identifiers hold no space, so an ordered match is a pattern over the joined sequence
    rule = lambda ids: "(^| )" + "( .*)? ".join(i.replace(".", "[.]") for i in ids) + "( |$)"
    cases = ", ".join(f"case when regexp_matches(sentence_ids, '{rule(ids)}') then '{name}' end" for name, ids in licenses.RULES)
    return rf"""
with known(normal, sentence_id) as (values {known}),
     s as (select doc_id, generate_subscripts(parts, 1) as place, unnest(parts) as sentence
           from (select doc_id, string_split_regex(regexp_replace(text, '[.!?:;]+(\s|$)', chr(10) || '\1', 'g'), '\n') as parts from documents where text is not null)),
     n as (select doc_id, place, trim(regexp_replace(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as normal from s),
     f as (select doc_id, count(*) as n_sentences, string_agg(sentence_id, ' ' order by place) as sentence_ids from n join known using (normal) group by doc_id)
select doc_id, n_sentences, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x is not null))), ' ') as licenses from f"""


def _wrapped_sql() -> str:
    known = ", ".join(f"('{text}', '{name}')" for text, name in licenses.WRAPPED.items())
    rule = lambda ids: "(^| )" + "( .*)? ".join(i.replace(".", "[.]") for i in ids) + "( |$)"
    cases = ", ".join(f"case when regexp_matches(sentence_ids, '{rule(ids)}') then '{name}' end" for name, ids in licenses.WRAPPED_RULES)
    return rf"""
with known(normal, sentence_id) as (values {known}),
     t as (select doc_id, regexp_replace(regexp_replace(text, '\n[^A-Za-z0-9\n]*\n', chr(1), 'g'), '[.!?]+(\s|$)', chr(1) || '\1', 'g') as text from documents where text is not null),
     g as (select doc_id, generate_subscripts(groups, 1) as g, unnest(groups) as part from (select doc_id, string_split(regexp_replace(text, '(^|[\n\x01])([^A-Za-z0-9\n\x01]*[0-9A-Za-z]{{1,3}}\))[ \t]', '\1\2' || chr(10), 'g'), chr(1)) as groups from t)),
     p as (select doc_id, g, list_filter(list_transform(string_split(regexp_replace(part, '[:;]+(\s|$)', chr(10) || '\1', 'g'), chr(10)),
                  lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') as parts from g),
     a as (select doc_id, g, parts, unnest(range(1, len(parts) + 1)) as i from p),
     r as (select doc_id, g, i, unnest(range(i, len(parts) + 1)) as j, parts from a),
     m as (select doc_id, g, i, max(j) as j, arg_max(sentence_id, j) as sentence_id from r join known on normal = array_to_string(parts[i:j], ' ') group by doc_id, g, i),
     o as (select *, max(j) over (partition by doc_id, g order by i rows between unbounded preceding and 1 preceding) as before from m),
     f as (select doc_id, count(*) as n_sentences, string_agg(sentence_id, ' ' order by g, i) as sentence_ids from o where before is null or before < i group by doc_id)
select doc_id, n_sentences, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x is not null))), ' ') as licenses from f"""


def _recognised_sql() -> str:
    """The known sentences and rules are tables here too; words are compared at each place, and a rule is walked through the places of its identifiers."""
    known, rules = licenses.vocabulary()
    table = ", ".join(f"('{text}', '{name}')" for text, name in known.items())
    steps = ", ".join(f"({k}, '{name}', {i}, '{x}', {len(ids)})" for k, (name, ids, _) in enumerate(rules) for i, x in enumerate(ids, 1))
    absent = ", ".join(f"({k}, '{x}')" for k, (_, _, out) in enumerate(rules) for x in out)
    plain = lambda t: f"trim(regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
with recursive known(sentence, sentence_id) as (values {table}),
     steps(rule, license, step, sentence_id, n) as (values {steps}),
     absent(rule, sentence_id) as (values {absent}),
     d as (select distinct doc_id, text from documents where text is not null),
     x as (select doc_id, text, list_concat(list_transform(flatten(list_transform(regexp_extract_all(text, '{licenses.TAG}', 1), lambda e: string_split_regex(e, '{licenses.JOINED}'))), lambda i: 'spdx license identifier ' || {plain("i")} || ' {licenses.END}'),
               list_transform(regexp_extract_all(text, '{licenses.heading()}', 1), lambda i: 'license heading ' || {plain("i")} || ' {licenses.END}')) as apart from d),
     t as (select doc_id, {plain("text")} || ' | ' || array_to_string(apart, ' | ') as normal from x),
     h as (select doc_id, string_split(normal, ' ') as words, sentence, sentence_id, len(string_split(sentence, ' ')) as m
           from t join known on contains(' ' || normal || ' ', ' ' || sentence || ' ')),
     p as (select doc_id, words, sentence, sentence_id, m, unnest(range(1, len(words) - m + 2)) as pos from h),
     o as (select doc_id, pos, arg_max(sentence_id, m) as sentence_id from p where words[pos] = split_part(sentence, ' ', 1) and array_to_string(words[pos:pos + m - 1], ' ') = sentence group by doc_id, pos),
     walk(doc_id, rule, step, pos) as (
        select doc_id, rule, 1, min(pos) from o join steps using (sentence_id) where step = 1 group by doc_id, rule
        union all
        select w.doc_id, w.rule, w.step + 1, (select min(o.pos) from o where o.doc_id = w.doc_id and o.pos > w.pos and o.sentence_id = s.sentence_id)
        from walk w join steps s on s.rule = w.rule and s.step = w.step + 1
        where exists (select 1 from o where o.doc_id = w.doc_id and o.pos > w.pos and o.sentence_id = s.sentence_id)),
     fit as (select distinct w.doc_id, s.license from walk w join steps s on s.rule = w.rule and s.step = w.step and s.n = w.step
             where not exists (select 1 from absent a join o on o.sentence_id = a.sentence_id where a.rule = w.rule and o.doc_id = w.doc_id)),
     l as (select doc_id, string_agg(license, ' ' order by license) as licenses from fit group by doc_id),
     f as (select doc_id, count(*) as n_sentences, string_agg(sentence_id, ' ' order by pos) as sentence_ids from o group by doc_id)
select doc_id, n_sentences, sentence_ids, coalesce(licenses, '') as licenses from f left join l using (doc_id)"""


ORACLES["op11_phrases"] = r"""
with p as (select row_number() over () as piece, lang, words from (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words from documents)),
     w as (select piece, lang, unnest(words) as x, generate_subscripts(words, 1) as i from p),
     run as (select lang, x, lead(x) over t as y, lead(x, 2) over t as z from w window t as (partition by piece order by i)),
     one as (select lang, x, count(*) as f from w group by all), n as (select lang, count(*) as n from w group by lang),
     two as (select lang, x, y, count(*) as f from run where y is not null group by all), three as (select lang, x, y, z, count(*) as f from run where z is not null group by all having count(*) >= 10),
     cuts as (select t.lang, t.x || ' ' || t.y as phrase, t.x as p1, t.y as p2, null as p3, t.f as a, 1 as k, l.f as l, r.f as r from two t join one l on l.lang = t.lang and l.x = t.x join one r on r.lang = t.lang and r.x = t.y where t.f >= 10
        union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.x, t.y, t.z, t.f, 1, l.f, r.f from three t join one l on l.lang = t.lang and l.x = t.x join two r on r.lang = t.lang and r.x = t.y and r.y = t.z
        union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.x, t.y, t.z, t.f, 2, l.f, r.f from three t join two l on l.lang = t.lang and l.x = t.x and l.y = t.y join one r on r.lang = t.lang and r.x = t.z),
     scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cuts),
     best as (select * from scored qualify row_number() over (partition by lang, p1, p2, p3 order by score, k) = 1),
     inner_pairs as (select lang, p1, p2, max(f) as f from (select lang, x as p1, y as p2, f from three union all select lang, y, z, f from three) group by all),
     kept as (select b.* from best b left join inner_pairs i on b.p3 is null and i.lang = b.lang and i.p1 = b.p1 and i.p2 = b.p2 where i.f is null or 100 * i.f < 50 * b.a),
     ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""


def _centroids_sql() -> str:
    """A round is three tables: nearest centroids, their vectors' sums by component, and the floors of the means."""
    far = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    nearest = lambda r: f"a{r} as materialized (select row, arg_min(k, (d, k)) as k, min(d) as d from (select row, k, {far} as d from v cross join c{r}) group by row)"
    rounds = []
    for r in range(ROUNDS):
        rounds += [
            nearest(r),
            f"s{r} as (select k, i, sum(q[i]) as s, count(*) as n from a{r} join v using (row) cross join range(1, {DIMS + 1}) t(i) group by k, i)",
            f"m{r} as (select k, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by k)",
            f"c{r + 1} as materialized (select k, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (k))",
        ]
    return f"""
with v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as q from embeddings
        where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
     c0 as materialized (select row_number() over (order by name, q) - 1 as k, q as c from (select sha256('{SEED}:' || vec_id) as name, q from v where vec_id is not null order by name, q limit {CENTROIDS})),
     {", ".join(rounds)}, {nearest(ROUNDS)},
     i as (select k, sum(d) as inertia from a{ROUNDS} group by k)
select vec_id, cast(k as int) as cluster, cast(d as bigint) as distance, cast(inertia as bigint) as cluster_inertia, cast((select sum(inertia) from i) as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256 from a{ROUNDS} join v using (row) join i using (k) join c{ROUNDS} using (k)"""


ORACLES["op7_url_filter"] = _url_sql()
ORACLES["op12_centroids"] = _centroids_sql()
ORACLES["op8_license_scan"] = _recognised_sql()
ORACLES["op8_license_scan_lines"] = _license_sql()
ORACLES["op8_license_scan_wrapped"] = _wrapped_sql()
