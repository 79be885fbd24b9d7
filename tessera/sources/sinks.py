"""Writing results so that readers never see half of one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes df to a new folder of its own and returns it; readers move on when they are given the new path."""
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def swap(spark: SparkSession, path: str, view: str) -> None:
    """Points this session's view at a published folder: in one step, and only after the write succeeded. Other sessions take the new path that publish() gives."""
    spark.read.parquet(path).createOrReplaceTempView(view)


def keep_newest(archives: DataFrame, prefix: str, stamp: str, keep: int) -> DataFrame:
    """The newest archives of each prefix; the rest is what a clean-up removes."""
    place = F.row_number().over(Window.partitionBy(prefix).orderBy(F.col(stamp).desc(), F.col("name").desc()))
    return archives.withColumn("kept", place <= keep)


def to_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def to_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Appends; each partition writes by itself. What replaces older rows is settled before, by operators.sync.upsert."""
    df.write.jdbc(url, table, mode="append", properties=properties)
