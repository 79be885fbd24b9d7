"""Shapes and sizes of assets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The shape that a kind of asset must have, and the surface it is shown on.
ORIENTATION = {"cover": "portrait", "header": "landscape", "hero": "landscape", "background": "landscape", "icon": "square"}
TARGET_PIXELS = {"cover": 600 * 900, "header": 460 * 215, "hero": 1920 * 620, "logo": 640 * 360, "background": 1920 * 1080, "bezel": 1920 * 1080, "icon": 256 * 256}
DEFAULT_PIXELS, TARGET_SHARE, SQUARE_TOLERANCE = 250_000, 0.5, 1.15
LARGE, UNKNOWN, SMALL = 0, 1, 2


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def orientation(width: Column, height: Column) -> Column:
    """portrait, landscape or square; null where either side is unknown."""
    known = (width > 0) & (height > 0)
    return F.when(known, F.when(height > width, "portrait").when(width > height, "landscape").otherwise("square"))


def shape_ok(kind: Column, width: Column, height: Column) -> Column:
    """False only where the shape is known and contradicts the kind."""
    want, got = _lookup(ORIENTATION, kind), orientation(width, height)
    square = (width / height).between(1 / SQUARE_TOLERANCE, SQUARE_TOLERANCE)
    return F.when(want.isNull() | got.isNull(), True).when(want == "square", square).otherwise((got == "square") | (got == want))


def resolution_band(kind: Column, width: Column, height: Column) -> Column:
    """0 for large enough for the kind's surface, 1 for unknown, 2 for small."""
    least = F.coalesce((_lookup(TARGET_PIXELS, kind) * TARGET_SHARE).cast("int"), F.lit(DEFAULT_PIXELS))
    return F.when((width > 0) & (height > 0), F.when(width * height >= least, LARGE).otherwise(SMALL)).otherwise(UNKNOWN)


def derived_size(ref: Column) -> tuple[Column, Column]:
    """Width and height that a file's name states (like 600x900), else nulls."""
    pattern = r"(?:^|[^0-9])(\d{2,5})x(\d{2,5})(?:[^0-9]|$)"
    side = lambda k: F.nullif(F.regexp_extract(ref, pattern, k), F.lit("")).cast("int")
    return side(1), side(2)


def region_rank(region: Column, wanted: list[str]) -> Column:
    """Place in the list of wanted regions; an unknown region stands behind them, an unwanted one last."""
    place = F.array_position(F.array(*map(F.lit, wanted)), region)
    return F.when(region.isNull() | (region == ""), len(wanted)).when(place > 0, place - 1).otherwise(len(wanted) + 1).cast("int")
