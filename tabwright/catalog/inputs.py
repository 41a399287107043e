"""Input tables of the registered queries, as expressions that Spark and the oracle read alike.

The given tables have no gaps, markers or constant columns, so some columns are derived from the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- documents with labels, gaps and constants; target ``lang`` ----------------------------------------------

DOCS_EXPRS = [
    "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic",
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS n_gap",
    "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS source_gap",
    "1 AS konst",
    "CASE WHEN doc_id % 200 = 0 THEN 'b' ELSE 'a' END AS near",
]
DOCS_SQL = f"SELECT {', '.join(DOCS_EXPRS)} FROM documents LEFT JOIN labels USING (doc_id)"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.selectExpr(*DOCS_EXPRS)


# ---- line items with derived columns of every semantic type --------------------------------------------------

LINE_EXPRS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
    "l_quantity > 25 AS l_big",
    "CAST(l_linenumber + l_orderkey % 6 AS INT) AS l_step",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_gap",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linenumber END AS l_line_gap",
    "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_linestatus END AS l_status_gap",
    "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity > 25 END AS l_big_gap",
]
LINE_SQL = f"SELECT {', '.join(LINE_EXPRS)} FROM lineitem"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*LINE_EXPRS)


# ---- customers with missing markers in text ------------------------------------------------------------------

MARKED_EXPRS = [
    "c_custkey",
    "CASE c_custkey % 10 WHEN 0 THEN ' N/A ' WHEN 1 THEN '?' WHEN 2 THEN 'None' WHEN 3 THEN '   ' WHEN 4 THEN 'NaN' "
    "WHEN 5 THEN 'missing' WHEN 6 THEN ' Null' WHEN 7 THEN 'nA' ELSE concat('  ', c_mktsegment, ' ') END AS segment",
    "concat(' ', c_name) AS name",
    "c_acctbal",
]
MARKED_SQL = f"SELECT {', '.join(MARKED_EXPRS)} FROM customer"


def marked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(*MARKED_EXPRS)


# ---- events with many equal rows -----------------------------------------------------------------------------

REPEATS_EXPRS = ["event_type", "user_id % 10 AS user_group"]
REPEATS_SQL = f"SELECT {', '.join(REPEATS_EXPRS)} FROM events"


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*REPEATS_EXPRS)


# ---- scored rows for the evaluation queries ------------------------------------------------------------------

SCORED_EXPRS = [
    "CASE WHEN l_extendedprice > 53000 THEN 1 ELSE 0 END AS label",
    "(l_quantity * 2 + l_linenumber) / CAST(107 AS DOUBLE) AS score",
    "CASE WHEN l_quantity * 2 + l_linenumber > 53 THEN 1 ELSE 0 END AS prediction",
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag_label",
    "CAST(l_linenumber % 3 AS INT) AS flag_prediction",
]
SCORED_SQL = f"SELECT {', '.join(SCORED_EXPRS)} FROM lineitem"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*SCORED_EXPRS)


# ---- a training and a test part of the line items ------------------------------------------------------------

IS_TRAIN, IS_TEST = "l_orderkey % 5 <> 0", "l_orderkey % 5 = 0"


def train_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).filter(IS_TRAIN)


def test_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).filter(IS_TEST)
