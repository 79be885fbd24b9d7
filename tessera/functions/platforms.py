"""Platforms by whatever name: canonical names, labels of a library, hardware named in titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .eras import GENERATIONS

# Names of a platform, in letters and digits only, by canonical name. `pc` is every home computer, whatever its maker or system.
ALIASES = {
    "atari2600": "atari2600", "atari5200": "atari5200", "atari7800": "atari7800", "amigacd32": "amigacd32 cd32", "3do": "3do 3dointeractivemultiplayer", "3ds": "3ds nintendo3ds newnintendo3ds",
    "nds": "nds nintendods", "n64": "n64 nintendo64", "gamecube": "gamecube nintendogamecube ngc", "wii": "wii", "wiiu": "wiiu", "switch": "switch nintendoswitch", "switch2": "switch2 nintendoswitch2 ounce",
    "snes": "snes supernintendoentertainmentsystem superfamicom sfc", "nes": "nes nintendoentertainmentsystem familycomputer famicom familycomputerdisksystem fds",
    "gb": "gameboy gb", "gbc": "gameboycolor gbc", "gba": "gba gameboyadvance", "virtualboy": "virtualboy", "colecovision": "colecovision", "intellivision": "intellivision", "vectrex": "vectrex",
    "dreamcast": "dreamcast", "saturn": "segasaturn saturn", "segacd": "segacd megacd segamegacd", "sega32x": "sega32x 32x", "genesis": "segagenesis genesis segamegadrivegenesis megadrive",
    "sms": "segams segamastersystem segamastersystemmarkiii mastersystem", "gamegear": "gamegear segagamegear", "sg1000": "sg1000 segasg1000", "jaguar": "jaguar atarijaguar", "jaguarcd": "jaguarcd atarijaguarcd",
    "lynx": "lynx atarilynx", "arcade": "mame arcade", "neogeo": "neogeo neogeoaes neogeomvs neogeoaesmvs", "neogeocd": "neogeocd", "ngp": "neogeopocket", "ngpc": "neogeopocketcolor",
    "ps1": "psx playstation ps1 psone", "ps2": "ps2 playstation2", "ps3": "ps3 playstation3", "ps4": "ps4 playstation4", "ps5": "ps5 playstation5", "psp": "psp playstationportable", "psvita": "psvita playstationvita",
    "pce": "turbogfx turbografx16pcengine pcengine turbografx turbografx16 pcenginesupergrafx", "pcecd": "tuboduo turboduo turbografx16pcenginecd pcenginecd turbografxcd",
    "xbox": "xbox", "xbox360": "xbox360", "xboxone": "xboxone", "supervision": "supervision watara wataraquickshotsupervision",
    "pc": "pc windows pcmicrosoftwindows microsoftwindows ibmpc dos msdos pcdos ibmpcdos pcbooter ibmpcbooter windows31 windows3x windows9x win32 win64 mac macintosh applemacintosh macos osx macosclassic linux steamos "
    "c64 commodore64 commodorec64128max commodore16 commodoreplus4 vic20 commodorevic20 commodorepet cbmpet amiga commodoreamiga apple2 appleii appleiigs appleiie apple2gs apple1 "
    "atari8bit atari800 atari8bitfamily atarixegs atarist ataristste ataristst zxspectrum sinclairzx81 zx81 sinclairql amstradcpc amstradpcw msx msx2 acornarchimedes acornelectron bbcmicro bbcmicrocomputersystem "
    "pc8801 necpc8801 pc8001 pc9801 pc98 pc9800series sharpx1 sharpx68000 x68000 fmtowns fm7 trs80 trs80colorcomputer tandycomputersystem ti994a",
}
# Words of a title that name hardware and nothing else, and the label of each.
TITLE_WORDS = {"32x": "sega 32x", "cd32": "amigacd32"}
_CANON = {a: c for c, names in ALIASES.items() for a in names.split()}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def bare(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", "")


def canon(label: Column) -> Column:
    """A platform's canonical name; what nobody knows stays as its letters and digits."""
    return F.coalesce(_map(_CANON)[bare(label)], bare(label))


def known(canonical: Column) -> Column:
    return F.coalesce(canonical.isin(*ALIASES), F.lit(False))


def from_title(title: Column) -> Column:
    """The label of the first word of a title that names hardware, null without one: a file's name is surer than its folder's."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return _map(TITLE_WORDS)[F.get(F.filter(words, lambda w: w.isin(*TITLE_WORDS)), 0)]


def catalog_label(display: Column, existing: Column) -> Column:
    """The label that a library (existing: its labels) has for a platform given by any name: the canonical name, if the library has it, else the first label that means the same, else the canonical name. Null for what is no platform."""
    t = canon(display)
    same = F.get(F.filter(F.array_sort(F.coalesce(existing, F.array().cast("array<string>"))), lambda p: canon(p) == t), 0)
    return F.when(known(t), F.when(F.coalesce(F.array_contains(existing, t), F.lit(False)), t).otherwise(F.coalesce(same, t)))


def contamination_suspect(entry: Column, platforms: Column) -> Column:
    """Whether a game of these platforms can't be the entry: its platform is none of them and older than all. A platform that nobody knows, or without a generation, is never suspect."""
    ours = canon(entry)
    theirs = F.array_distinct(F.transform(F.filter(F.coalesce(platforms, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), lambda p: canon(p)))
    first = F.array_min(F.filter(F.transform(theirs, lambda p: _map(GENERATIONS)[p]), lambda g: g.isNotNull()))
    return F.coalesce(known(ours) & (F.size(theirs) > 0) & ~F.array_contains(theirs, ours) & (_map(GENERATIONS)[ours] < first), F.lit(False))


def game_years(recorded: Column, first: Column, own: Column, has_store: Column, stated: Column) -> Column:
    """The years in which a game came out, sorted; null where nothing says.

    recorded: what a provider states of the game; else the year of its first release; else the entry's own year, but
    not one of a store, which is when it was listed. A year that a person stated can only be added below the others.
    """
    years = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(recorded, F.array().cast("array<int>")))))
    years = F.when(F.size(years) > 0, years).when(first.isNotNull(), F.array(first)).when(own.isNotNull() & ~has_store, F.array(own)).otherwise(F.array().cast("array<int>"))
    wider = stated.isNotNull() & ((F.size(years) == 0) | (stated < F.array_min(years)))
    years = F.when(F.coalesce(wider, F.lit(False)), F.concat(F.array(stated), years)).otherwise(years)
    return F.when(F.size(years) > 0, years)
