"""What the names of dumped files say: title, regions, languages, versions, flags and kind of release."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Region names and language codes in brackets, in lower case.
REGIONS = ["usa", "europe", "japan", "world", "germany", "france", "spain", "italy", "korea", "china", "brazil", "australia", "asia", "netherlands", "sweden", "norway", "denmark", "finland", "portugal", "russia", "poland", "canada", "mexico", "taiwan", "hong kong", "uk", "united kingdom", "greece"]
LANGUAGES = "en fr de es it pt nl ja ko zh ru sv".split()
# Region codes of one letter, which may stand together, as (JU).
REGION_CODES = {"U": "USA", "E": "Europe", "J": "Japan", "W": "World", "A": "Australia", "F": "France", "G": "Germany", "I": "Italy", "S": "Spain", "K": "Korea", "B": "Brazil", "C": "China"}
#: Kinds of release, the least official first, by the tags of a name: what a round bracket begins with, or is.
TAGS = {
    "Hack": ("hack",),
    "Homebrew": ("homebrew", "aftermarket", "hb", "pd", "public domain", "19xx", "20xx", "19??", "20??"),
    "Unlicensed": ("unl", "unlicensed", "pirate"),
    "Prototype": ("proto", "prototype", "beta", "alpha", "debug", "pre-release", "prerelease"),
    "Demo": ("demo", "trade demo", "sample", "kiosk", "taikenban"),
}
#: The same by a square bracket of one letter, with a number or none.
CODES = {"h": "Hack", "t": "Hack", "p": "Unlicensed"}
#: Languages that a translation's tag names before its version.
TONGUES = "english french german spanish italian portuguese dutch russian polish korean chinese swedish".split()
#: Folders that tell the kind of what is below them, by words of their names.
FOLDERS = {"Translation": ("translation", "translations", "translated"), "Hack": ("hacks", "romhacks"), "Homebrew": ("homebrew", "homebrews", "aftermarket"), "Unlicensed": ("unlicensed", "unlicenced", "bootleg", "bootlegs", "pirate", "pirates")}


def bare_title(name: Column) -> Column:
    """What stands before the first bracket, without an ending."""
    return F.trim(F.regexp_extract(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,4}$", ""), r"^([^(\[]*)", 1))


def groups(name: Column) -> Column:
    """The contents of the round brackets, in order."""
    return F.regexp_extract_all(name, F.lit(r"\(([^()]*)\)"), F.lit(1))


def first_group(name: Column, pattern: str) -> Column:
    """The first round-bracket content that fits a pattern; empty if none does."""
    return F.coalesce(F.get(F.filter(groups(name), lambda g: F.lower(g).rlike(pattern)), 0), F.lit(""))


def region(name: Column) -> Column:
    one = "|".join(REGIONS)
    return first_group(name, rf"^({one})(, ?({one}))*$")


def regions(name: Column) -> Column:
    """All regions that a name tells, as a list: names in a bracket, or letters that stand for them, as in (JU); empty if none."""
    letters = "".join(REGION_CODES)
    of = F.create_map(*(F.lit(x) for pair in REGION_CODES.items() for x in pair))
    coded = F.get(F.filter(groups(name), lambda g: g.rlike(f"^[{letters}]{{1,3}}$")), 0)
    named = F.filter(F.split(region(name), ", ?"), lambda r: r != "")
    return F.when(F.size(named) > 0, named).when(coded.isNotNull(), F.transform(F.split(coded, ""), lambda c: of[c])).otherwise(F.array().cast("array<string>"))


def flags(name: Column) -> Column:
    """The contents of the square brackets, in order: what a dump's checkers say of it."""
    return F.regexp_extract_all(name, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))


def languages(name: Column) -> Column:
    one = "|".join(LANGUAGES)
    return first_group(name, rf"^({one})([,+] ?({one}))*$|^m[0-9]+$")


def version(name: Column) -> Column:
    return first_group(name, r"^(v[0-9]|prg[0-9]|version)")


def revision(name: Column) -> Column:
    return first_group(name, r"^rev([ .a-z0-9]|$)")


def disc(name: Column) -> Column:
    return first_group(name, r"^(disc|disk|side)( |$)")


def verified(name: Column) -> Column:
    return F.contains(name, F.lit("[!]"))


def year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\(((?:19|20)[0-9]{2})\)", 1), F.lit("")).cast("int")


def _kind_of_group(group: Column) -> Column:
    """What a round bracket in lower case tells: by all of it, or by its first word without a number behind it."""
    word = F.regexp_replace(F.regexp_extract(group, "^([^ ,]*)", 1), "([^0-9])[0-9]+$", "$1")
    lead = F.regexp_extract(word, "^([a-z]+)-", 1)
    told = F.lit(None).cast("string")
    for kind, tags in reversed(TAGS.items()):
        told = F.when(group.isin(*tags) | word.isin(*tags) | lead.isin(*tags), kind).otherwise(told)
    signed = group.rlike("^t[+-][a-z]{2,4}$")
    versioned = F.regexp_extract(group, "^([a-z]+) v?[. ]*[0-9]", 1).isin(*TONGUES)
    return F.when(signed | versioned | F.startswith(group, F.lit("translat")), "Translation").otherwise(told)


def _kind_of_flag(flag: Column) -> Column:
    code = F.regexp_extract(flag, "^([a-z])[0-9]*$", 1)
    return F.when(flag.rlike("^t[+-] *[a-z]{2,4}"), "Translation").otherwise(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))[F.nullif(code, F.lit(""))])


def release_type(name: Column) -> Column:
    """The least official kind of release that a name's tags tell, null for a commercial one.

    Only brackets count, and whole words in them: a game that is called so, and (Hackers), tell nothing.
    """
    low = F.lower(name)
    told = F.concat(F.transform(groups(low), _kind_of_group), F.transform(flags(low), _kind_of_flag))
    return F.coalesce(*(F.when(F.array_contains(told, kind), kind) for kind in ("Translation", *TAGS)))


def path_type(path: Column) -> Column:
    """The kind of release that the words of a path's folders tell; `rom hacks` and `home brew` count as one word."""
    words = F.split(F.regexp_replace(F.lower(path), "(home)[ _-]+(brew)|(rom)[ _-]+(hacks)", "$1$2$3$4"), "[^a-z]+")
    return F.coalesce(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, tags))), kind) for kind, tags in FOLDERS.items()))
