"""URL filters: host and path rules, then a weighted vocabulary that an Aho-Corasick automaton counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, ascii_lower


class Rule(NamedTuple):
    """A verdict for a host with its subdomains, and for the paths that start with `path`."""

    verdict: str
    rule: str  # host and path as one string, like "com/en/"

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))
#: One strict term rejects a URL; soft terms reject it from SOFT_LIMIT distinct ones on.
STRICT = ("casino", "porn", "spam", "viagra", "xxx")
SOFT = ("ads", "bets", "bonus", "cheap", "click", "free", "pills", "prize", "track", "win")
SOFT_LIMIT = 2


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.rule).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def term_counter(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF: the distinct strict and soft terms of each URL, whole terms only."""

    @F.pandas_udf("strict int, soft int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        lower = str.maketrans(UPPER, LOWER)
        alike = lambda c: c.isascii() and c.isalnum()

        def found(url: str | None) -> tuple[int, int]:
            url = (url or "").translate(lower)  # of other letters some become ASCII, or two, in lower case
            terms = set()
            for end, term in automaton.iter(url):
                first = end - len(term)
                if not (first >= 0 and alike(url[first])) and not (end + 1 < len(url) and alike(url[end + 1])):
                    terms.add(term)
            return len(terms.intersection(strict)), len(terms.intersection(soft))

        for urls in parts:
            yield pd.DataFrame([found(u) for u in urls], columns=["strict", "soft"])

    return count


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict and soft (distinct terms found) of each row.

    A rule that fits decides; otherwise the vocabulary does. Null URL, or one without ://: empty host
    and path, no rule; a null one has no terms and is allowed. Repeated rows: judged alike. Empty
    table: no rows. A term counts only where neither neighbour is an ASCII letter or digit.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("terms", term_counter(tuple(strict), tuple(soft))("url"))
    name, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("terms.strict") >= 1) | (F.col("terms.soft") >= soft_limit), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("terms.strict").alias("strict"), F.col("terms.soft").alias("soft"))
