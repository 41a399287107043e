"""Session helpers: a default local session and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "tabwright") -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass in your own session instead."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends.

    The folder is the session's ``spark.checkpoint.dir``; only a session in one JVM without that setting gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tabwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it back.

    Used where a later step must see the very same rows again (row numbers given by a sort) even if an executor is
    lost; a later step reads only the columns it needs.
    """
    path = own_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 1_000_000
ROWS_PER_TASK = 20_000


def spread_small(df: DataFrame, n_rows: int) -> DataFrame:
    """A small table over all cores: it may come as one split, and CPU-heavy counting would then use one core.

    Tables above ``SMALL_ROWS`` are left alone; they have enough splits of their own and are not worth moving.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if ROWS_PER_TASK < n_rows <= SMALL_ROWS else df


def gather_small(df: DataFrame, n_rows: int) -> DataFrame:
    """At most one partition per ``ROWS_PER_TASK`` rows, for fits that run a job per iteration."""
    return df.coalesce(max(1, -(-n_rows // ROWS_PER_TASK)))
