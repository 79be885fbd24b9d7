"""Functions of this library by name in SQL: Arrow-batched twins of the Column forms, one aggregate and one table function.

The Column forms run inside the JVM and are what the library itself uses; the twins are for SQL text
that can't take a Column. Both give the same values (tests/test_twins.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators import scoring as S

from . import gate as G, names as N, titles as T

_A = re.ASCII
_STEPS = [(re.compile(p, _A), by) for p, by in ((T.COMMA_ARTICLE, " "), (T.ENDING, ""), ("[™®©]", " "), (r"\((?:\s*(\d{4})\s*|[^)]*)\)", lambda m: f" {m[1] or ''} "), (r"\[[^\]]*\]", " "))]
_EDITION, _LEADING, _TRAILING, _YEAR = (re.compile(p, _A) for p in (T.EDITION, T.LEADING, T.TRAILING_EDITION, r"^(19|20)\d{2}$"))


def norm(title: str | None) -> str:
    s = (title or "").lower()
    for pattern, by in _STEPS:
        s = pattern.sub(by, s)
    s = _EDITION.sub(" ", s.replace("&", " and ").replace("+", " plus "))
    words = re.sub("[^a-z0-9]+", " ", s).split()
    return _TRAILING.sub(r"\1\2", _LEADING.sub("", " ".join(T.ROMAN.get(w, w) for w in words)))


def _value(word: str) -> int | None:
    return int(word) if re.fullmatch(r"\d{1,2}", word, _A) else G.NUMERALS.get(word)


def _significant(words: list[str]) -> list[str]:
    return [w for w in words if w not in G.NOISE and not _YEAR.match(w)]


def _subtitle(title: str) -> str:
    for mark in (":", " - ", " – "):
        if mark in title:
            return title.split(mark, 1)[1]
    return ""


def gate_score(owned: str | None, candidate: str | None) -> tuple[bool, float] | None:
    """(ok, score) of a candidate for an owned title; None where one has no words."""
    if owned is None or candidate is None:
        return None
    qn, cn = norm(owned), norm(candidate)
    q, c = list(dict.fromkeys(qn.split())), list(dict.fromkeys(cn.split()))
    if not q or not c:
        return None
    if qn.replace(" ", "") == cn.replace(" ", ""):
        return True, 2.0
    sig_q, sig_c, values_c = _significant(q), _significant(c), {_value(w) for w in c} - {None}
    covered = bool(sig_q) and all(w in c or _value(w) in values_c for w in sig_q)
    only_q, only_c = [w for w in sig_q if w not in sig_c], [w for w in sig_c if w not in sig_q]
    subs = [sorted(_significant(list(dict.fromkeys(norm(_subtitle(t)).split())))) for t in (owned, candidate)]
    variant = bool(only_q) != bool(only_c) and all(_value(w) is not None for w in only_q + only_c) and bool(subs[0]) and subs[0] == subs[1]
    extra = [_value(w) for w in c if w not in q and _value(w) is not None]
    sequel = not variant and bool(extra) and 1 not in extra and not any(_value(w) is not None for w in q)
    both = len(set(q) & set(c))
    return (covered or variant) and not sequel, both / len(q) + both / len(c)


def parse_name(name: str | None) -> dict | None:
    """What the tags of a dump's name say."""
    if name is None:
        return None
    groups = re.findall(r"\(([^()]*)\)", name)
    first = lambda pattern: next((g for g in groups if re.search(pattern, g.lower(), _A)), "")
    one = "|".join(N.LANGUAGES)
    year = re.search(r"\(((?:19|20)[0-9]{2})\)", name)
    return {
        "languages": first(rf"^({one})([,+] ?({one}))*$|^m[0-9]+$"), "version": first(r"^(v[0-9]|prg[0-9]|version)"), "revision": first(r"^rev([ .a-z0-9]|$)"), "disc": first(r"^(disc|disk|side)( |$)"),
        "verified": "[!]" in name, "year": int(year[1]) if year else None,
    }


def _norm_batch(titles: pd.Series) -> pd.Series:
    return titles.map(norm, na_action=None)


def _gate_batch(owned: pd.Series, candidates: pd.Series) -> pd.DataFrame:
    rows = [gate_score(a, b) or (None, None) for a, b in zip(owned, candidates, strict=True)]
    return pd.DataFrame(rows, columns=["ok", "score"])


def _parse_batch(names: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([parse_name(n) or {} for n in names], columns=["languages", "version", "revision", "disc", "verified", "year"])
    return rows.astype({"year": "Int32"})


def library_score(kind: pd.Series, score: pd.Series, votes: pd.Series) -> int:
    """The universal score of one game's ratings, null without a weight; as operators.scoring.bayes has it."""
    totals = {True: [0, 0], False: [0, 0]}
    for k, s, v in zip(kind, score, votes, strict=True):
        if pd.isna(s):
            continue
        critic = k == "critic"
        full = S.CRITIC_VOTES if critic else S.USER_VOTES
        c = (S.UNKNOWN_CRITIC if critic else S.UNKNOWN_USER) if pd.isna(v) else max(0.0, min(1.0, v / full))
        weight = (S.CRITIC_WEIGHT if critic else 1 - S.CRITIC_WEIGHT) * c
        totals[critic][0] += int(round(weight * 1e6))
        totals[critic][1] += int(round(weight * (c * s + (1 - c) * S.MEAN) * 1e6))
    w, wa = totals[True][0] + totals[False][0], totals[True][1] + totals[False][1]
    if not w:
        return None
    drawn = wa / w if totals[True][0] else S.NO_CRITIC * (wa / w) + (1 - S.NO_CRITIC) * S.MEAN
    return int(round(drawn))


class ExplainHandles:
    """explain_handles(TABLE(keys) PARTITION BY identity_id ORDER BY (ns, val)): how an identity is known, a row for each key and one for all.

    keys: identity_id, ns, val, kind. Rows are passed on as they come; nothing of a partition is held.
    """

    @staticmethod
    def analyze(keys: AnalyzeArgument) -> AnalyzeResult:
        if not keys.isTable:
            raise ValueError("explain_handles takes a table of keys")
        return AnalyzeResult(StructType([StructField("identity_id", LongType()), StructField("place", IntegerType()), *(StructField(c, StringType()) for c in ("ns", "val", "explanation"))]))

    def __init__(self) -> None:
        self.identity, self.place, self.exact, self.spaces, self.last = None, 0, 0, 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.identity, self.place, self.exact = row["identity_id"], self.place + 1, self.exact + (row["kind"] == "exact")
        self.spaces, self.last = self.spaces + (row["ns"] != self.last), row["ns"]
        how = "stated by its source" if row["kind"] == "exact" else "concluded from a name"
        yield self.identity, self.place, row["ns"], row["val"], f"{row['ns']} {row['val']}: {how}"

    def terminate(self) -> Iterator[tuple]:
        if self.place:
            yield self.identity, None, None, None, f"{self.place} keys of {self.spaces} kinds, {self.exact} stated"


def register(spark: SparkSession) -> None:
    """Makes norm, parse_name, gate_score, library_score and explain_handles known to a session's SQL."""
    spark.udf.register("norm", F.pandas_udf(_norm_batch, "string"))
    spark.udf.register("gate_score", F.pandas_udf(_gate_batch, "ok boolean, score double"))
    spark.udf.register("parse_name", F.pandas_udf(_parse_batch, "languages string, version string, revision string, disc string, verified boolean, year int"))
    spark.udf.register("library_score", F.pandas_udf(library_score, "int"))
    spark.udtf.register("explain_handles", F.udtf(ExplainHandles))
