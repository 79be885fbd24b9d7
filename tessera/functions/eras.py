"""When platforms were on sale, their generations, and what a date or a list of platforms rules out. Missing data rule out nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# First and last year of commercial software by platform label; 9999 is open.
ERAS = {
    "nes": (1983, 1995), "snes": (1990, 2003), "n64": (1996, 2002), "gamecube": (2001, 2007), "wii": (2006, 2020), "wiiu": (2012, 2019),
    "nintendo switch": (2017, 9999), "nintendo switch 2": (2025, 9999), "gameboy": (1989, 2001), "gameboy color": (1998, 2003), "gba": (2001, 2008),
    "nds": (2004, 2015), "3ds": (2011, 2022), "virtualboy": (1995, 1996), "sega ms": (1985, 1996), "sega genesis": (1988, 1998), "sega cd": (1991, 1996),
    "sega 32x": (1994, 1996), "sega saturn": (1994, 2000), "dreamcast": (1998, 2002), "gamegear": (1990, 1997), "psx": (1994, 2006), "ps2": (2000, 2013),
    "ps3": (2006, 2020), "ps4": (2013, 9999), "ps5": (2020, 9999), "psp": (2004, 2014), "psvita": (2011, 2021), "xbox": (2001, 2009), "xbox360": (2005, 2019),
    "xbox one": (2013, 9999), "atari 2600": (1977, 1992), "atari 5200": (1982, 1984), "atari 7800": (1986, 1992), "lynx": (1989, 1995), "jaguar": (1993, 1996),
    "jaguar cd": (1994, 1996), "neogeo": (1990, 2004), "neogeopocketcolor": (1998, 2001), "turbo gfx": (1987, 1999), "tubo duo": (1987, 1999), "3do": (1993, 1996),
    "amiga": (1985, 1996), "amigacd32": (1993, 1994), "apple2": (1977, 1993), "colecovision": (1982, 1984), "intellivision": (1979, 1990),
    "zx spectrum": (1982, 1992), "supervision": (1992, 1996), "mame": (1975, 9999),
}
#: Years after the last in which a game may still appear.
TAIL = 4
# Canonical names of labels that have another.
TOKENS = {
    "gameboy": "gb", "gameboy color": "gbc", "nintendo switch": "switch", "nintendo switch 2": "switch2", "sega ms": "sms", "sega genesis": "genesis", "sega cd": "segacd",
    "sega 32x": "sega32x", "sega saturn": "saturn", "psx": "ps1", "xbox one": "xboxone", "atari 2600": "atari2600", "atari 5200": "atari5200", "atari 7800": "atari7800",
    "jaguar cd": "jaguarcd", "neogeopocketcolor": "ngpc", "turbo gfx": "pce", "tubo duo": "pcecd", "mame": "arcade",
}
# Hardware generations by canonical name; those that span several (pc) have none.
GENERATIONS = {
    "atari2600": 2, "atari5200": 2, "atari7800": 3, "intellivision": 2, "colecovision": 2, "vectrex": 2, "sg1000": 2, "nes": 3, "sms": 3, "gb": 3, "gamegear": 3, "lynx": 3, "supervision": 3,
    "genesis": 4, "snes": 4, "neogeo": 4, "neogeocd": 4, "sega32x": 4, "segacd": 4, "amigacd32": 4, "pce": 4, "pcecd": 4, "gbc": 4, "ngp": 4, "ngpc": 4, "virtualboy": 4, "arcade": 4,
    "ps1": 5, "saturn": 5, "n64": 5, "3do": 5, "jaguar": 5, "jaguarcd": 5, "gba": 5, "dreamcast": 6, "ps2": 6, "gamecube": 6, "xbox": 6, "nds": 6, "psp": 6,
    "ps3": 7, "xbox360": 7, "wii": 7, "psvita": 7, "3ds": 7, "ps4": 8, "xboxone": 8, "wiiu": 8, "switch": 8, "ps5": 9, "switch2": 9,
}


def _look_up(table: Mapping[str, object], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def token(label: Column) -> Column:
    """A platform's canonical name: that of its label, or the label itself in lower case without spaces around."""
    plain = F.lower(F.trim(label))
    return F.coalesce(_look_up(TOKENS, plain), plain)


def last_year(label: Column) -> Column:
    """The last year of a platform given by label or canonical name; null where none is known."""
    return _look_up({TOKENS.get(k, k): v for k, (_, v) in ERAS.items()}, token(label))


def first_year(label: Column) -> Column:
    return _look_up({TOKENS.get(k, k): v for k, (v, _) in ERAS.items()}, token(label))


def impossible(label: Column, year: Column) -> Column:
    """Whether a game of that year is too new for the platform; never whether it is too old, as old games are sold again."""
    return F.coalesce(year > last_year(label) + TAIL, F.lit(False))


def generation(label: Column) -> Column:
    return _look_up(GENERATIONS, token(label))


def contamination_suspect(label: Column, platforms: Column) -> Column:
    """Whether a game's platforms lack this one and all that have a generation are of a later one: probably another game of that title."""
    named = F.filter(F.transform(platforms, token), lambda p: p.isNotNull() & (p != ""))
    earliest = F.array_min(F.transform(named, lambda p: _look_up(GENERATIONS, p)))
    return F.coalesce((F.size(named) > 0) & ~F.array_contains(named, token(label)) & (generation(label) < earliest), F.lit(False))


def hardware_ok(ours: Column, theirs: Column) -> Column:
    """Whether two lists of platforms meet; a list that is null or empty states nothing and refuses nothing."""
    stated = lambda ps: F.filter(F.transform(F.coalesce(ps, F.array().cast("array<string>")), token), lambda p: p.isNotNull() & (p != ""))
    a, b = stated(ours), stated(theirs)
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def era_aware_pick(candidates: Column, label: Column) -> Column:
    """Of candidates (structs with year and rank): on a platform whose era has ended the earliest dated one, else the first by rank."""
    dated = F.filter(candidates, lambda c: c["year"].isNotNull())
    earliest = F.array_min(F.transform(dated, lambda c: F.struct(c["year"].alias("y"), c["rank"].alias("r"), c.alias("c"))))["c"]
    first = F.array_min(F.transform(candidates, lambda c: F.struct(c["rank"].alias("r"), c.alias("c"))))["c"]
    return F.when(F.coalesce(last_year(label) < 9999, F.lit(False)) & (F.size(dated) > 0), earliest).otherwise(first)
