"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once and leaves one bit; measurements and bits are kept, so that a policy (a
versioned choice of rules) or an ablation is a bitwise operation over the ledger, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import words_of

#: Rules by bit: name and when a text fails. Fixed order: a rule's bit never changes, new rules go to the end.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {"base": ("too_few_words", "repeated_windows"), "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "word_length")}
CURRENT = "v1"


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input row as `row`, and measurements of its text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Null and empty texts measure 0 everywhere. Nothing is shuffled: a text is measured within its row.
    """
    one = lambda x: F.xxhash64(x)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", one).alias("hashes"),
    )
    # a window's hash, at each place that has two words after it
    windows = F.expr("case when n_words < 3 then cast(array() as array<bigint>) else zip_with(zip_with(slice(hashes, 1, size(hashes) - 2), slice(hashes, 2, size(hashes) - 2), (a, b) -> xxhash64(a, b)), slice(hashes, 3, size(hashes) - 2), (a, b) -> xxhash64(a, b)) end")
    rows = rows.withColumn("windows", windows).drop("hashes")
    # only texts that repeat a window need its places: equal hashes stand side by side once sorted with their places
    paired = F.expr("case when size(array_distinct(windows)) < size(windows) then sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) end")
    rows = rows.withColumn("paired", paired).drop("windows")
    rows = rows.withColumn("before", F.expr("slice(paired, 1, size(paired) - 1)")).withColumn("after", F.expr("slice(paired, 2, size(paired))"))
    # i and j of neighbours with one hash; each place comes up at most twice
    rows = rows.withColumn("equal", F.expr("filter(zip_with(before, after, (a, b) -> case when a.h = b.h then array(a.i, b.i) end), x -> x is not null)")).drop("paired", "before", "after")
    rows = rows.withColumn("places", F.expr("sort_array(array_distinct(flatten(equal)))")).drop("equal")
    covered = F.expr("case when places is null then 0L else 3L + aggregate(zip_with(slice(places, 2, size(places)), slice(places, 1, size(places) - 1), (b, a) -> least(3, b - a)), 0L, (s, x) -> s + x) end")
    measured = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    # out of a generator, so that a filter on measurements stays above it: pushed below, it would measure each text again for every rule
    return rows.select("row", F.inline(F.array(measured)))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input row as `row`, the measurements and `failed`: a bit for each rule that the text fails."""
    bits = [F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text_col).withColumn("failed", failed)


def passes(policy: str = CURRENT, failed: Column | None = None) -> Column:
    """Whether the ledger's bits pass a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents, how many fail it, how many only it rejects, and how many are kept without it.

    The ledger is first counted by its bits (at most 2^rules rows), and all figures come from those counts.
    """
    chosen = mask_of(policy)
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name in POLICIES[policy]]
    each = masks.select("failed", "n", F.inline(F.array(*rules)))
    hit, left = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.lit(chosen) - F.col("bit")) == 0
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).cast("long")
    return each.groupBy("rule").agg(count(F.lit(True)).alias("documents"), count(hit).alias("failed"), count(hit & left).alias("only_rule"), count(left).alias("kept_without"))


def keep_good(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """docs without the rows that a policy rejects, all columns kept; nothing is shuffled."""
    return ledger(docs, text_col).filter(passes(policy)).select("row.*")
