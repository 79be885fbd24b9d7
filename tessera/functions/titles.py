"""Titles as Column expressions: the key that titles are compared by, and the parts of a title.

Every function takes and returns Columns, runs inside whole-stage code and never calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Roman numerals that are read as numbers (a lone i, v or x is more often a letter).
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12", "xiii": "13", "xiv": "14"}
# Phrases that name an edition, as patterns.
EDITIONS = (
    "game of the year edition", "goty", "definitive edition", "remaster(ed)?", "complete edition", "deluxe edition", "gold edition", "enhanced edition",
    "ultimate edition", "collector'?s edition", "digital deluxe", "standard edition", "legacy edition", "premium edition", "special edition",
)
# File endings of dumps.
ENDINGS = "m3u iso chd cue bin img mdf nrg ccd rvz wbfs nkit gcm gcz cso pbp gdi cdi rom nds 3ds zip 7z rar".split()
# Articles that catalogues put behind a comma.
ARTICLES = "the a an le la les las el los il lo gli die der das ein eine".split()
# Edition marks at the end of a display title, the longest first.
MARKS = (
    "game of the year edition", "prepare to die edition", "definitive edition", "complete edition", "enhanced edition", "remastered edition", "deluxe edition",
    "special edition", "anniversary edition", "game of the year", "remastered", "enhanced", "definitive", "complete", "deluxe", "goty", "hd",
)
# Hardware tokens that may end a title, and the platform each names.
HARDWARE = {"32x": "sega32x", "cd32": "amigacd32"}

COMMA_ARTICLE = rf",\s*({'|'.join(ARTICLES)})\b"
ENDING = rf"\.({'|'.join(ENDINGS)})$"
EDITION = rf"\b({'|'.join(EDITIONS)})\b"
LEADING = "^((the|a|an)( |$))+"
TRAILING_EDITION = r"^(.+) editions?(( \d{4})*)$"
STORE_YEAR = r"^(.*?)\s*\((19[5-9]\d|20[0-4]\d)\)\s*$"


def canon(platform: Column) -> Column:
    """A platform's token: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(platform, F.lit(""))), "[^a-z0-9]", "")


def norm(title: Column, platform: Column | None = None, keep_years: bool = True, strip_editions: bool = True) -> Column:
    """The key of a title. The order of the steps matters: each works on what those before have left."""
    s = F.lower(F.coalesce(title, F.lit("")))
    s = F.regexp_replace(s, COMMA_ARTICLE, " ")
    s = F.regexp_replace(s, ENDING, "")
    s = F.regexp_replace(s, "[™®©]", " ")
    s = F.regexp_replace(s, r"\((?:\s*(\d{4})\s*|[^)]*)\)", " $1 ") if keep_years else F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"\[[^\]]*\]", " ")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    if strip_editions:
        s = F.regexp_replace(s, EDITION, " ")
    words = F.array_remove(F.split(F.regexp_replace(s, "[^a-z0-9]+", " "), " "), "")
    numbers = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    s = F.array_join(F.transform(words, lambda w: F.coalesce(numbers[w], w)), " ")
    s = F.regexp_replace(s, LEADING, "")
    if strip_editions:
        s = F.regexp_replace(s, TRAILING_EDITION, "$1$2")
    if platform is not None:
        for token, name in HARDWARE.items():
            s = F.when(canon(platform).isin(token, name), F.regexp_replace(s, f"^(.+?)( {token})+$", "$1")).otherwise(s)
    return s


def strip_edition(title: Column) -> Column:
    """A display title without one edition mark at its end; as it is where nothing would be left."""
    cut = F.regexp_replace(title, rf"(?i)^(.*?)[\s:–-]*(?:{'|'.join(MARKS)})\s*$", "$1")
    return F.when(F.length(F.trim(cut)) > 0, cut).otherwise(title)


def same_title(a: Column, b: Column) -> Column:
    """Equal but for case, spaces and punctuation."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return bare(a) == bare(b)


def store_title(title: Column) -> Column:
    """A title without the year that a store puts behind it."""
    return F.when(title.rlike(STORE_YEAR), F.regexp_extract(title, STORE_YEAR, 1)).otherwise(title)


def store_year(title: Column) -> Column:
    """The year that a store puts behind a title, from 1950 to 2049; else null."""
    return F.nullif(F.regexp_extract(title, STORE_YEAR, 2), F.lit("")).cast("int")


def title_head(title: Column) -> Column:
    """What stands before the first colon or spaced dash."""
    return F.trim(F.regexp_extract(title, r"^(.*?)(:| - | – |$)", 1))


def subtitle(title: Column) -> Column:
    """What follows the first colon, or where there is none the first spaced dash; empty without."""
    colon, dash = F.regexp_extract(title, r"(?s)^[^:]*:(.*)$", 1), F.regexp_extract(title, r"(?s)^.*? - (.*)$", 1)
    return F.when(F.contains(title, F.lit(":")), colon).when(F.contains(title, F.lit(" - ")), dash).otherwise(F.regexp_extract(title, r"(?s)^.*? – (.*)$", 1))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def anchor_class(key: Column, names: Column) -> Column:
    """How a key stands in the normalised names, the best of all: exact, anchored (at an end), interior or norun."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))

    def rank(name: Column) -> Column:
        full = F.concat(F.lit(" "), name, F.lit(" "))
        return F.when(name == key, 3).when((F.length(key) > 0) & (full.startswith(padded) | full.endswith(padded)), 2).when((F.length(key) > 0) & F.contains(full, padded), 1).otherwise(0)

    best = F.coalesce(F.array_max(F.transform(names, rank)), F.lit(0))
    return F.when(best == 3, "exact").when(best == 2, "anchored").when(best == 1, "interior").otherwise("norun")
