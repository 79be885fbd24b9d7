"""The acceptance gate: may a candidate's title stand for an owned one, and how sure is the match."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .titles import norm, subtitle

# Words that don't tell titles apart.
NOISE = (
    "edition editions deluxe premium ultimate complete definitive collectors collector goty anniversary enhanced remaster remastered remake redux hd sd 4k uhd classic original "
    "standard special gold platinum digital bundle pack pc steam windows version release the a an of and s plus"
).split()
# Numerals by value; x is left out, being a letter as often as ten.
NUMERALS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "xi": 11, "xii": 12, "xiii": 13}
# What a way of matching is worth, and what a title's place in a name costs.
BASES = {"manual": 100, "store_id": 96, "era": 88, "name": 85, "judged_name": 72, "judged_entry": 72}
TITLE_BASED = ("name", "judged_name", "judged_entry", "era")
PENALTIES = {"exact": 0, "anchored": -12, "interior": -50, "norun": -45}
YEAR_TOLERANCE, EXACT_YEAR = 1, 0.4


def tokens(key: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(key, " "), ""))


def significant(words: Column) -> Column:
    """The words that identify a title: no noise, no year."""
    return F.filter(words, lambda w: ~w.isin(NOISE) & ~w.rlike(r"^(19|20)\d{2}$"))


def value(word: Column) -> Column:
    """A numeral's value, in either notation; else null."""
    roman = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.when(word.rlike(r"^\d{1,2}$"), F.expr("0") + F.regexp_extract(word, r"^\d{1,2}$", 0).try_cast("int")).otherwise(roman[word])


def values(words: Column) -> Column:
    return F.array_compact(F.transform(words, value))


def covers(sig: Column, words: Column) -> Column:
    """Every identifying word is among the candidate's, a numeral by its value."""
    had = values(words)
    return (F.size(sig) > 0) & F.forall(sig, lambda w: F.array_contains(words, w) | F.coalesce(F.array_contains(had, value(w)), F.lit(False)))


def features(title: Column) -> Column:
    """struct of what the gate looks at in a title: key, squashed, tokens, significant, values, subtitle.

    Made once for each title, below whatever join brings pairs together.
    """
    key = norm(title)
    words = tokens(key)
    sub = F.array_sort(significant(tokens(norm(subtitle(title)))))
    return F.struct(key.alias("key"), F.replace(key, F.lit(" "), F.lit("")).alias("squashed"), words.alias("tokens"), significant(words).alias("significant"), values(words).alias("values"), sub.alias("subtitle"))


def numbering_variant(owned: Column, candidate: Column) -> Column:
    """Titles (as features) that differ by a number that one of them leaves out, with equal subtitles."""
    a, b = owned["significant"], candidate["significant"]
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    numbers = lambda x: F.forall(x, lambda w: value(w).isNotNull())
    one_side = (F.size(only_a) + F.size(only_b) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    return one_side & numbers(only_a) & numbers(only_b) & (F.size(owned["subtitle"]) > 0) & (owned["subtitle"] == candidate["subtitle"])


def judged(owned: Column, candidate: Column, years: Column | None = None, candidate_year: Column | None = None, later_ok: bool = False) -> Column:
    """As judged_features, for titles."""
    return judged_features(features(owned), features(candidate), years, candidate_year, later_ok)


def judged_features(owned: Column, candidate: Column, years: Column | None = None, candidate_year: Column | None = None, later_ok: bool = False) -> Column:
    """struct(ok, score) of a candidate for one owned title, both as features; years: the years in which the owned one came out.

    Null where the years contradict: such a title doesn't count at all. Missing years refuse nothing.
    """
    qt, ct = owned["tokens"], candidate["tokens"]
    both = F.size(F.array_intersect(qt, ct))
    squashed = owned["squashed"] == candidate["squashed"]
    variant = numbering_variant(owned, candidate)
    extra = values(F.array_except(ct, qt))
    sequel = ~variant & (F.size(extra) > 0) & ~F.array_contains(extra, 1) & (F.size(owned["values"]) == 0)
    ok = squashed | ((covers(owned["significant"], ct) | variant) & ~sequel)
    score = F.when(squashed, F.lit(2.0)).otherwise(both / F.size(qt) + both / F.size(ct))
    out = F.struct(ok.alias("ok"), score.cast("double").alias("score"))
    valid = (F.size(qt) > 0) & (F.size(ct) > 0)
    if years is not None and candidate_year is not None:
        low, high = F.array_min(years), F.array_max(years)
        agree = candidate_year.between(low - YEAR_TOLERANCE, high + YEAR_TOLERANCE)
        if later_ok:
            agree = agree | (candidate_year > high)
        exact = F.coalesce(F.array_contains(years, candidate_year), F.lit(False))
        out = F.struct(ok.alias("ok"), (score + F.when(exact, EXACT_YEAR).otherwise(0.0)).cast("double").alias("score"))
        valid = valid & F.coalesce(agree, F.lit(True))
    return F.when(valid, out)


def best_judged(titles: Column, candidate: Column) -> Column:
    """struct(ok, score) over all owned titles, in their order: one counts if its score is above the best so far, and a refused one never takes the place of an accepted one."""
    c = features(candidate)

    def step(best: Column, title: Column) -> Column:
        own = judged_features(features(title), c)
        better = F.coalesce((own["score"] > best["score"]) & (own["ok"] | ~best["ok"]), F.lit(False))
        return F.when(better, own).otherwise(best)

    return F.aggregate(titles, F.struct(F.lit(False).alias("ok"), F.lit(0.0).alias("score")), step)


def safe_aliases(owned: Column, aliases: Column) -> Column:
    """The aliases that may stand for an owned title where candidates are accepted: no initials, which are one identifying word of four letters at most for a title of twice as many."""
    letters = lambda key: F.length(F.replace(key, F.lit(" "), F.lit("")))
    whole = letters(norm(owned))

    def safe(alias: Column) -> Column:
        key = norm(alias)
        short = (F.size(significant(F.split(key, " "))) == 1) & (letters(key) <= 4) & (whole >= 2 * letters(key))
        return (key != "") & ~short

    return F.filter(aliases, safe)


def confidence(matched_by: Column, anchor: Column, listed: Column, impossible: Column) -> Column:
    """0 to 100: what the way of matching is worth, less what the title's place and the platform cost.

    anchor: anchor_class() or null without a name; listed: whether the platform is among the candidate's
    (null: nothing is listed); impossible: whether the hardware is older than the candidate.
    """
    lookup = lambda d, c: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))[c]
    by_title = matched_by.isin(*TITLE_BASED)
    cost = F.when(by_title, F.coalesce(lookup(PENALTIES, anchor), F.lit(0))).otherwise(0)
    misfit = F.when(by_title & (listed == F.lit(False)), F.when(impossible, -42).otherwise(-22)).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(lookup(BASES, matched_by), F.lit(65)) + cost + misfit))
    return F.when(matched_by == "manual", 100).otherwise(score).cast("int")


def confidence_reason(matched_by: Column, anchor: Column, listed: Column, impossible: Column) -> Column:
    by_title = matched_by.isin(*TITLE_BASED)
    weak = F.when(by_title & anchor.isin("interior", "norun"), F.concat(anchor, F.lit(" title match")))
    misfit = F.when(by_title & (listed == F.lit(False)), F.when(impossible, "platform impossible for this game's era").otherwise("platform not listed"))
    plain = F.when(matched_by == "store_id", "matched by store ID").when(matched_by == "name", "exact title match").otherwise("matched")
    return F.when(matched_by == "manual", "pinned by hand").otherwise(F.coalesce(F.nullif(F.concat_ws("; ", weak, misfit), F.lit("")), plain))
