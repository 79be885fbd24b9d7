"""Asking the catalog: a small search language and filter tokens, both turned into Columns at plan time."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_TERM = re.compile(r'(-?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')
_NUMBER = re.compile(r"^([<>]=?|=)?(\d+)$")


def contains(column: Column, text: str) -> Column:
    """Literal, whatever characters the text has; case doesn't matter."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(text.lower()))


def parse(query: str, title: Column, texts: Mapping[str, Column], numbers: Mapping[str, Column], low_confidence: int = 60) -> Column:
    """All terms must hold: word (in the title), field:text (contained), field:>N for numbers, -term (not).

    A field that isn't known is no field: the term is looked for in the title as it stands.
    """
    held = F.lit(True)
    for minus, field, quoted, plain in _TERM.findall(query or ""):
        value = quoted or plain
        number = _NUMBER.match(value)
        if field in numbers and (number or value in ("low", "high")):
            column = numbers[field].try_cast("double")
            if value in ("low", "high"):
                one = column < low_confidence if value == "low" else column >= low_confidence
            else:
                sign, n = number[1] or "=", float(number[2])
                one = {"<": column < n, ">": column > n, "<=": column <= n, ">=": column >= n, "=": column == n}[sign]
        elif field in texts:
            one = contains(texts[field], value)
        else:
            one = contains(title, f"{field}:{value}" if field else value)
        one = F.coalesce(one, F.lit(False))
        held = held & (~one if minus else one)
    return held


class Filters:
    """Filter tokens by name, or by a prefix like `source:`; a token that nobody registered is an error, not everything."""

    def __init__(self, plain: Mapping[str, Column], prefixed: Mapping[str, Callable[[str], Column]]):
        self.plain, self.prefixed = dict(plain), dict(prefixed)

    def one(self, token: str) -> Column:
        if token in self.plain:
            return self.plain[token]
        prefix, colon, rest = token.partition(":")
        if colon and rest and prefix in self.prefixed:
            return self.prefixed[prefix](rest)
        raise ValueError(f"unknown filter {token!r}")

    def all(self, include: Sequence[str] = (), exclude: Sequence[str] = (), needed: bool = False) -> Column:
        if needed and not include and not exclude:
            raise ValueError("a rule must say something")
        held = F.lit(True)
        for token in include:
            held = held & F.coalesce(self.one(token), F.lit(False))
        for token in exclude:
            held = held & ~F.coalesce(self.one(token), F.lit(False))
        return held


def cards(entries: DataFrame, card: str, best: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row for each card: the columns of its first entry by `best` (a total order), platforms united, sources summed."""
    w = Window.partitionBy(card)
    rows = entries.withColumns({"_place": F.row_number().over(w.orderBy(*best)), "n_entries": F.count(F.lit(1)).over(w), "card_sources": F.sum("n_sources").over(w), "platforms": F.array_join(F.sort_array(F.collect_set("platform").over(w)), ",")})
    return rows.filter("_place = 1").select(card, *columns, "platforms", "card_sources", "n_entries")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows by key; unlike an offset it costs the same on every page."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def hidden(override: Column, by_type: Column, by_genre: Column) -> Column:
    """Whether an entry is no game: a hand-made decision holds both ways, else its type or a genre tells."""
    return F.coalesce(override == "hide", F.coalesce(by_type, F.lit(False)) | F.coalesce(by_genre, F.lit(False)))


#: What `status` and `identified` may be, and what each asks of an entry.
STATUS = {"all": "not utility", "owned": "not utility and owned = 1", "wanted": "not utility and owned = 0", "utilities": "utility"}
IDENTIFIED = {"all": "true", "identified": "identified", "unidentified": "not identified"}


def matching(
    entries: DataFrame, filters: Filters, q: str = "", query: str = "", source: str | None = None, platform: str | None = None, has_kind: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
    status: str = "all", identified: str = "all", texts: Sequence[str] = ("platform",), numbers: Sequence[str] = ("score",),
) -> DataFrame:
    """The entries that a grid query asks for; its total is their count.

    entries: title, platform, sources and kinds (arrays), owned (1 or 0), identified and utility (booleans),
    and the fields that `query` may name. Null fields hold no condition. Arguments that nobody knows are
    errors, not everything.
    """
    if status not in STATUS or identified not in IDENTIFIED:
        raise ValueError(f"status is one of {sorted(STATUS)}, identified one of {sorted(IDENTIFIED)}")
    held = contains(F.col("title"), q) & parse(query, F.col("title"), {t: F.col(t) for t in texts}, {n: F.col(n) for n in numbers})
    held = held & F.expr(STATUS[status]) & F.expr(IDENTIFIED[identified]) & filters.all(include, exclude)
    for column, value in (("sources", source), ("kinds", has_kind)):
        if value:
            held = held & F.array_contains(column, value)
    return entries.filter(held & (F.col("platform") == platform) if platform else held)


def grid(entries: DataFrame, filters: Filters, sort: Sequence[str] = ("title",), limit: int = 60, offset: int = 0, key: Sequence[str] = ("norm_key", "platform"), **asked) -> DataFrame:
    """A page of the entries that match; sort: columns, with a minus for falling order, and `key` settles ties."""
    rows = matching(entries, filters, **asked)
    unknown = {s.lstrip("-") for s in sort} - set(rows.columns)
    if unknown or limit < 0 or offset < 0:
        raise ValueError(f"no columns to sort by: {sorted(unknown)}; limit and offset are 0 or more")
    column = lambda s: F.lower(s) if dict(rows.dtypes)[s] == "string" else F.col(s)
    order = [column(s[1:]).desc_nulls_last() if s[:1] == "-" else column(s).asc_nulls_last() for s in sort]
    return page(rows, [*order, *map(F.col, key)], limit, offset)
