"""Libraries in XML: read by row tag, merged by id so that foreign elements stay, written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Elements of several values, and the attribute that each stands for.
SEVERAL = {"Genre": "genres", "Developer": "developers", "Publisher": "publishers", "Series": "series"}


def elements(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """The elements of a tag as rows of strings. Without a schema every child that an element has is a column."""
    reader = spark.read.format("xml").option("rowTag", tag).option("inferSchema", "false").option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).load(path)


def platform_games(spark: SparkSession, path: str) -> DataFrame:
    """Games of platform files: title, platform, source_id, genres, developers, publishers, series, description, release_year, release_date.

    Games without a title are no games. A game that names no platform has its file's; an id of the database comes before its own.
    """
    columns = ["Title", "Platform", "DatabaseID", "ID", *SEVERAL, "Notes", "ReleaseDate"]
    rows = elements(spark, path, "Game", ", ".join(f"`{c}` string" for c in columns))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts: list[Column] = [F.when(text(t).isNotNull(), F.filter(F.transform(F.split(t, ";"), lambda x: F.trim(x)), lambda x: x != "")).alias(a) for t, a in SEVERAL.items()]
    stem = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]*?)(\.[^./]*)?$", 1)
    year = F.regexp_extract("ReleaseDate", r"^\d{4}", 0)
    return rows.select(
        text("Title").alias("title"), F.coalesce(text("Platform"), stem).alias("platform"), F.coalesce(F.nullif("DatabaseID", F.lit("")), F.nullif("ID", F.lit("")), F.lit("")).alias("source_id"), *parts,
        text("Notes").alias("description"), F.when(year != "", year.cast("int")).alias("release_year"), F.when(year != "", F.substring("ReleaseDate", 1, 10)).alias("release_date"),
    ).filter("title is not null")


def merged(there: DataFrame, ours: DataFrame, id: str) -> DataFrame:
    """there with ours written over it by id: what ours says is new, all else of an element stays, as do elements of others.

    Nulls of ours say nothing. Elements without an id are nobody's and stay. Ours must have each id once.
    """
    new = [c for c in ours.columns if c != id]
    rest = [c for c in there.columns if c != id and c not in new]
    old = there.select(F.col(id).alias("_id"), *(F.col(c).alias(f"_old_{c}") for c in there.columns))
    both = old.join(ours.select(F.col(id).alias("_id"), *(F.col(c).alias(f"_new_{c}") for c in new)), "_id", "full_outer")
    value = lambda c: F.coalesce(f"_new_{c}", f"_old_{c}") if c in there.columns else F.col(f"_new_{c}")
    return both.select(F.col("_id").alias(id), *(F.col(f"_old_{c}").alias(c) for c in rest), *(value(c).alias(c) for c in new))


def write(rows: DataFrame, path: str, root: str, tag: str) -> None:
    """One file a task, each whole; nulls are left out."""
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)
