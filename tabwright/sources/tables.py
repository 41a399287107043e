"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.split import TEST, TRAIN


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the file once more."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, or CSV by file ending."""
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_split(df: DataFrame, path: str) -> str:
    """A table with a ``split`` column, one folder per part, so that a reader of one part skips the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def union_presplit(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts as one table, told apart by ``split``."""
    return train.withColumn("split", F.lit(TRAIN)).unionByName(test.withColumn("split", F.lit(TEST)))
