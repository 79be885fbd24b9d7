"""Loading tables: typed, with an empty table where a file is missing, and lists of several kinds of file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at a path with the given columns; an empty one where there is none, nulls for columns it lacks."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return aligned(found, empty.schema)


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns, in its order and types; missing ones are null."""
    return df.select(*((df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def tsv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Ownership lists: title, id and at will platform and detail, by tabs; rows without a title are dropped."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="title string, source_id string, platform string, detail string", mode="PERMISSIVE")
    return rows.filter(F.trim(F.coalesce("title", F.lit(""))) != "").select(
        "title", F.lit(source).alias("source"), "source_id", F.coalesce(F.nullif("platform", F.lit("")), F.lit(source)).alias("platform"), F.coalesce("detail", F.lit("")).alias("detail")
    )


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, without its malformed lines."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED", enforceSchema=True)


def json_library(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A library exported as one JSON array, or as lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def dat_roms(spark: SparkSession, path: str) -> DataFrame:
    """(name, region, serial, crc, md5, sha1) of the game blocks of clrmamepro files, each read as a whole."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\bgame \((.*?\n)\)"), F.lit(1))).alias("block"))
    field = lambda name: F.nullif(F.coalesce(F.nullif(F.regexp_extract("block", rf'\b{name} "([^"]*)"', 1), F.lit("")), F.regexp_extract("block", rf"\b{name} ([^\s\")]+)", 1)), F.lit(""))
    return blocks.select(field("name").alias("name"), field("region").alias("region"), field("serial").alias("serial"), F.upper(field("crc")).alias("crc"), F.lower(field("md5")).alias("md5"), F.lower(field("sha1")).alias("sha1"))


def in_order(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Sources one after another, with their place as `seq`: whatever comes first wins later folds."""
    out = None
    for seq, (name, frame) in enumerate(frames):
        one = frame.withColumns({"source": F.lit(name), "seq": F.lit(seq)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def without_owned(wishes: DataFrame, owned: DataFrame, key: str, store: str, store_id: str) -> DataFrame:
    """Wishes whose key nobody owns, each (store, id) once."""
    return wishes.join(owned.select(key).distinct(), key, "left_anti").dropDuplicates([store, store_id])


def carried_over(previous: DataFrame, regenerated: Sequence[str], source: str = "source") -> DataFrame:
    """Rows of an earlier run whose sources this run doesn't make anew."""
    return previous.filter(~F.col(source).isin(list(regenerated)))


def joined_detail(*parts: Column) -> Column:
    """The parts that say something, joined by ' | '."""
    return F.concat_ws(" | ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
