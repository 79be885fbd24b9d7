"""What the operators of this subpackage share: inputs, words, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of what is neither a space nor U+0009 to U+000D.
GAPS = r"[\x20\x09-\x0D]+"
#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a group of equal keys that one task takes.
GROUP_ROWS = 4096
#: Bytes of text in a batch, beyond which there are more batches.
BATCH_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table; its further columns, whatever their names, don't matter."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    kept = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(kept)
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a written table in the shared folder: computed once, of known size, and read again by whatever uses it.

    Spark deletes the shuffle files of the write when it ends: what was lost later is read from the table.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cleared(*tables: DataFrame) -> None:
    """Empties staged tables that nothing reads any more: no rows are written over theirs."""
    for table in tables:
        path = table.inputFiles()[:1]
        if path:
            table.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path[0].rpartition("/")[0])


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "members", each: int = GROUP_ROWS) -> DataFrame:
    """rows (with a doc_id) joined with one row a group: a group of n rows is dealt to n / each tasks.

    Groups of more than `each` rows are looked up first; there are at most rows / each of them. That
    table is written, so that Spark knows its size and broadcasts it or not by its own threshold.
    """
    parts = F.ceil(F.col(count) / each).cast("int")
    large = staged(groups.filter(F.col(count) > each).select(*keys, parts.alias("__parts")), "large")
    dealt = rows.join(large, keys, "left").withColumn("__part", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.coalesce("__parts", F.lit(1))).cast("int"))
    each_part = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(each_part, [*keys, "__part"]).drop("__part")


def partitions(spark: SparkSession) -> int:
    """How many parts the deployment asks for; every packed exchange is cut in as many."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batches_of(spark: SparkSession, text_bytes: int) -> int:
    """Into how many batches so many bytes of text are dealt: a batch is held by one Python worker, of some BATCH_BYTES at any size of the corpus."""
    return max(4 * partitions(spark), -(-text_bytes // BATCH_BYTES), 1)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(docs[text_col])).alias("n")).first().n or 0
