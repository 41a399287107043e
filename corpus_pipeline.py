"""From documents to packed training sequences: quality rules, near copies, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import mixing, near_dup, packing, quality_rules, repeats
from tabwright.llm.common import table, written

#: Bytes of an Arrow batch. Each task that hands texts to Python holds a batch a few times over, in the JVM and in Python;
#: at Spark's own 64 MB that is several hundred MB an executor.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    small_batches(spark)
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more."""
    small_batches(spark)
    return near_dup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or an earlier place, has."""
    small_batches(spark)
    return repeats.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("near_copies", near_copies), ("passages", passages), ("source_mix", mix), ("packing", pack)]

#: Tokenizing and rounding a mix have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if place + 1 < len(STAGES) else docs
    return docs
