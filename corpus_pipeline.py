"""From documents to packed sequences: quality rules, exact dedup, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. run() writes each stage's rows to the shared folder, rereads them for the next, and empties what
the one after has been made from.

Null ids: never copies of another document, packed like all others. Null and empty texts: the quality
rules reject them; any later stage takes them as empty. Repeated rows: their texts are equal, so one id
stays, with each of its rows. An empty table: no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import exact_dedup, ngram_join, packing, quality, substring
from tessera.llm.common import cleared, documents, staged
from tessera.llm.queries import BPE, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go, those with null or empty texts among them."""
    return quality.keep_good(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays; null ids count as the smallest."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, similarity 0.8) the one with the smallest doc_id stays; null ids stay."""
    return ngram_join.drop_near_duplicates(docs, size=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that occur earlier leave the texts; documents stay, if need be empty."""
    return substring.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    pieces = packing.pack(docs, tokenizer(BPE), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("exact dedup", drop_exact), ("n-gram jaccard join", drop_near), ("substring dedup", drop_passages), ("packing", pack)]

#: Packing encodes texts, which SQL doesn't; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        cleared(*made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
