"""Paths, file endings, names of files and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Endings that an asset may have.
ASSET_ENDINGS = "jpg jpeg png gif webp bmp ico tif tiff avif svg pdf mp4 webm mkv mov m4v ogv".split()
# Folders that only wrap others, and folders of media.
WRAPPERS = ("archive", "favorite", "favorites", "roms", "usa", "europe", "japan", "world")
MEDIA_FOLDERS = ("images", "manuals", "media", "videos", "boxart", "snaps")


def last(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ending(path: Column) -> Column:
    """The ending in lower case, empty without one."""
    return F.lower(F.regexp_extract(last(path), r"\.([A-Za-z0-9]{1,5})$", 1))


def safe_ending(value: Column, default: str = "jpg") -> Column:
    """An ending that an asset may have; whatever else comes in, of URLs or free text, gives the default."""
    bare = F.ltrim(last(F.lower(F.trim(F.regexp_extract(F.coalesce(value, F.lit("")), "^[^?#]*", 0)))), F.lit("."))
    return F.when(bare.isin(ASSET_ENDINGS), bare).otherwise(default)


def grid_asset(name: Column) -> tuple[Column, Column]:
    """(id, kind) of a grid file: <id>p cover, <id> header, <id>_hero, _logo, _icon; nulls for others."""
    pattern = r"^([0-9]+)(p|_hero|_logo|_icon)?\.(png|jpg|jpeg|ico)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    kind = F.when(part(2) == "p", "cover").when(part(2) == "", "header").otherwise(F.substring(part(2), 2, 9))
    return F.nullif(part(1), F.lit("")), F.when(part(1) != "", kind)


def container_members(text: Column) -> Column:
    """The files that a cue sheet, a gdi or an m3u list names."""
    quoted = F.regexp_extract_all(text, F.lit(r'(?im)^\s*FILE\s+"([^"]+)"'), F.lit(1))
    listed = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^[^#\s].*\.[A-Za-z0-9]+\s*$") & ~x.rlike("(?i)^FILE "))
    return F.when(F.size(quoted) > 0, quoted).otherwise(F.transform(listed, lambda x: F.trim(x)))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template like {system}/{game}.{ext} with its values, without empty parts of the path."""
    out = F.lit(template)
    for name, value in values.items():
        safe = F.regexp_replace(F.trim(F.replace(F.coalesce(value, F.lit("")), F.lit("/"), F.lit("-"))), r"[. ]+$", "")
        out = F.replace(out, F.lit("{" + name + "}"), safe)
    return F.array_join(F.filter(F.split(out, "/"), lambda p: ~p.isin("", ".")), "/")


def file_title(title: Column) -> Column:
    """A title as a file's name: what file systems refuse becomes an underscore."""
    return F.rtrim(F.regexp_replace(title, r"""[\\/:*?"<>|']""", "_"))


# Fixed value: the name space of the ids of exported games.
GUID_SPACE = "6c0f4b2e-9a1d-4e7c-8b3a-0b3a8b3a0b3a"


def guid(key: Column, space: str = GUID_SPACE) -> Column:
    """The name-based UUID (version 5) of a key in a name space; a null key counts as empty."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(F.coalesce(key, F.lit("")), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def duration(seconds: Column) -> Column:
    """A rough duration to act on."""
    minutes, hours = seconds / 60, seconds / 3600
    coarse = F.when(minutes >= 10, 5 * F.bround(minutes / 5, 0)).otherwise(F.bround(minutes, 0)).cast("int")
    long = F.when(hours < 10, F.format_string("%.1f hours", F.bround(hours, 1))).otherwise(F.concat(F.bround(hours, 0).cast("int").cast("string"), F.lit(" hours")))
    return F.when(seconds < 60, "under a minute").when(seconds < 90, "about a minute").when(minutes < 60, F.concat(coarse.cast("string"), F.lit(" min"))).otherwise(long)
