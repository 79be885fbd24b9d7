"""Which files make one game: loose files, members of a collection, folders, and the discs of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.names import bare_title
from tessera.functions.paths import MEDIA_FOLDERS, WRAPPERS, ending, last

# Fixed value: the pattern of a disc's name, as it must be for equal groups.
DISC = r"^(disc|disk|cd|dvd|side|part|track)\s*[\-_.]?\s*([0-9]{1,2}|[ivx]{1,4}|[ab])$"


def games(files: DataFrame, endings: list[str]) -> DataFrame:
    """(id, system, game) of files (id, system, path); game is empty for files that are none.

    A folder with titled files right in it is a collection: they are the games, folders in it are too, its
    other files are not. A folder of discs is one game, as is one with files deeper in it only. What a
    folder is takes all of its files, so their marks are counted over the folder, not in a loop.
    """
    folders = F.slice(F.split("path", "/"), 2, F.greatest(F.size(F.split("path", "/")) - 2, F.lit(0)))
    # leading folders that only wrap
    skip = F.aggregate(folders, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, d: F.when(s["on"] & F.lower(d).isin(*WRAPPERS, *MEDIA_FOLDERS), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))), lambda s: s["n"])
    rows = files.withColumns({"_folders": folders, "_name": last(F.col("path"))}).withColumn("_rest", F.slice("_folders", skip + 1, F.size("_folders")))
    title = F.coalesce(F.nullif(bare_title(F.col("_name")), F.lit("")), F.col("_name"))
    rows = rows.withColumns({"_top": F.get("_rest", F.lit(0)), "_sub": F.get("_rest", F.lit(1)), "_depth": F.size("_rest"), "_rom": ending(F.col("path")).isin(endings), "_title": title})
    inside = (F.col("_depth") == 1) & F.col("_rom")
    disc = inside & F.lower("_title").rlike(DISC)
    w = Window.partitionBy("system", F.lower("_top"))
    rows = rows.withColumns({"_discs": F.max(disc).over(w), "_members": F.max(inside & ~disc).over(w), "_inside": inside & ~disc})
    folder = lambda c: F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"^([^(\[]*)", 1)), F.lit("")), c)
    game = (
        F.when(F.col("_depth") == 0, F.when(F.col("_rom"), F.col("_title")).otherwise(""))
        .when(F.col("_discs"), folder(F.col("_top")))
        .when(F.col("_inside"), F.col("_title"))
        .when(F.col("_members"), F.when(F.col("_depth") > 1, folder(F.col("_sub"))).otherwise(""))
        .otherwise(folder(F.col("_top")))
    )
    return rows.select("id", "system", game.alias("game"))
