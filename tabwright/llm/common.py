"""Helpers of the training-data operators: tables, written intermediate results, ranks, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that part words; ``bytes.split()`` parts at exactly these.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session in one JVM (tests) gets a temporary folder; any other session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tabwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: later steps read the very same rows, also after executors are lost, and only the columns
    they need. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Remove a written folder when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, n_rows: int) -> DataFrame:
    """Add ``name``: a gapless rank from 0 within each group, in a fixed pseudo-random order of the ``order`` columns.

    A group may hold most rows: each is split into buckets by a hash of ``order``; the rank is the number of rows in
    earlier buckets plus the place in the own bucket. ``n_rows`` (a count of ``df``) sets the number of buckets; a
    bucket holds about 20,000 rows of a table with one group. Group columns must not be null. Rows equal in
    ``order`` get different ranks, in any order.
    """
    buckets = max(256, n_rows // 20_000)
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(F.xxhash64(*order), *order))
    return (
        keyed.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + place - 1).cast("long"))
        .drop("_bucket", "_before")
    )


def n_words(text: Column) -> Column:
    """Number of words of a text, natively: each word with the space around it becomes one character; null: 0."""
    squeezed = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.when(text.rlike(WORD), F.length(squeezed)).otherwise(0).cast("long")
