"""Report tables: overview, findings, issues with decisions, and settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import kind_of, nan_to_null, numeric_columns, quoted, text_columns
from tabwright.operators.profile import class_distribution, duplicate_rows, global_missing, table_moments
from tabwright.operators.quality import Issue

# Shown when nothing was chosen or decided.
NOT_SET = "N/A"
NO_DECISION = "Default/No Action"
SETTINGS = ("missing_strategy", "outlier_strategy", "scaling_strategy", "encoding_strategy")
DEFAULT_TEST_SIZE = 0.2


def overview(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(target).alias("target"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(df.columns) - 1).alias("n_features"),
    )


def settings(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """``setting, value`` of the preparation."""
    rows = [(name, str(config.get(name, NOT_SET))) for name in SETTINGS]
    rows.append(("test_size", f"{float(config.get('test_size', DEFAULT_TEST_SIZE)) * 100:.0f}%"))
    return spark.createDataFrame(rows, "setting string, value string")


def numeric_findings(df: DataFrame, target: str | None = None, digits: int = 2) -> DataFrame:
    """``column, mean, std`` (sample) of numeric columns without the target."""
    columns = numeric_columns(df, exclude=[target])
    stats = table_moments(df.select(*[quoted(c) for c in columns]), columns)[2] if columns else {}
    rows = [(c, s["mean"], s["std"]) for c, s in stats.items()]
    table = df.sparkSession.createDataFrame(rows, "column string, mean double, std double")
    return table.withColumns({c: F.round(c, digits) for c in ("mean", "std")})


def target_findings(df: DataFrame, target: str) -> DataFrame:
    """Text target: count and percentage per class. Other target: its range."""
    if kind_of(df.schema[target].dataType) == "text":
        return class_distribution(df, target).select(
            F.col("label").alias("value"), "n", F.round("percent", 1).alias("percent"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        )
    x = quoted(target).cast("double")
    return nan_to_null(df).agg(
        F.lit("range").alias("value"), F.count(x).alias("n"), F.lit(None).cast("double").alias("percent"),
        F.round(F.min(x), 2).alias("low"), F.round(F.max(x), 2).alias("high"),
    )


def findings(df: DataFrame, target: str) -> DataFrame:
    """All exploratory findings as ``finding, name, value``."""

    def rows(table: DataFrame, finding: str, name: Column, value: Column) -> DataFrame:
        return table.select(F.lit(finding).alias("finding"), name.alias("name"), value.cast("double").alias("value"))

    missing, repeats, numbers = global_missing(df), duplicate_rows(df), numeric_findings(df, target)
    about_target = target_findings(df, target)
    spark = df.sparkSession
    shape = spark.createDataFrame(
        [("numeric_columns", float(len(numeric_columns(df)))), ("text_columns", float(len(text_columns(df))))],
        "name string, value double",
    )
    parts = [
        rows(missing, "missing", F.lit("cells"), F.col("missing_cells")),
        rows(missing, "missing", F.lit("percent"), F.col("missing_percent")),
        rows(shape, "shape", F.col("name"), F.col("value")),
        rows(numbers, "mean", F.col("column"), F.col("mean")),
        rows(numbers, "std", F.col("column"), F.col("std")),
        rows(about_target, "target_count", F.col("value"), F.col("n")),
        rows(repeats, "duplicates", F.lit("rows"), F.col("duplicates")),
        rows(repeats, "duplicates", F.lit("percent"), F.col("duplicate_percent")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def issue_decisions(spark: SparkSession, issues: Sequence[Issue], decisions: Mapping[str, str]) -> DataFrame:
    """``place, type, column, severity, decision``; a decision is found by issue id or by the older position keys."""
    rows = []
    for i, issue in enumerate(issues):
        kind, column = issue["type"], issue["column"] or "global"
        keys = (issue["issue_id"], f"{kind}_{i}_{column}", f"{kind}_{i}")
        decision = next((decisions[k] for k in keys if k in decisions), NO_DECISION)
        rows.append((i, kind, column, issue["severity"], decision))
    return spark.createDataFrame(rows, "place int, type string, column string, severity string, decision string")
