"""Values and rows that only full precision tells apart: microseconds, decimals, large whole numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.inputs import table
from tabwright.operators import balance, prepare, profile, repair, split

BIG = "123456789012345678"
DECIMAL_SQL = (
    f"SELECT CAST('{BIG}' AS DECIMAL(38, 4)) + CAST(CAST(l_orderkey AS VARCHAR) AS DECIMAL(38, 4)) * CAST('0.0001' AS DECIMAL(5, 4)) AS amount, "
    "l_returnflag FROM lineitem"
)
SPARK_DECIMAL = [
    f"CAST(CAST('{BIG}' AS DECIMAL(22, 4)) + CAST(l_orderkey AS DECIMAL(16, 0)) * CAST('0.0001' AS DECIMAL(5, 4)) AS DECIMAL(38, 4)) AS amount",
    "l_returnflag",
]


def amounts(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*SPARK_DECIMAL)


def distinct_decimal(spark, folder):
    found = profile.distinct_stats(amounts(spark, folder), ["amount"])["amount"]
    return spark.createDataFrame([found], "n_unique bigint, top bigint")


def duplicates_decimal(spark, folder):
    return profile.duplicate_rows(amounts(spark, folder)).select("n_rows", "duplicates")


def encode_target_decimal(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("CAST(l_quantity AS DECIMAL(12, 2)) AS target", "CAST(l_quantity AS DOUBLE) AS quantity")
    coded = prepare.encode_target(rows, "target", prepare.target_codes(rows, "target"))
    return coded.groupBy("quantity", "label").agg(F.count("*").alias("n"))


BIGINT_BOUNDS = {"v": (9007199254740993.0 + 200, 9007199254740993.0 + 2_000_000)}


def bigints(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderkey", "9007199254740993 + 2 * o_orderkey AS v")


def cap_bigint(spark, folder):
    capped, _ = repair.handle_outliers(bigints(spark, folder), {"v": repair.CAP}, {}, BIGINT_BOUNDS)
    return capped.select("o_orderkey", "v")


def remove_bigint(spark, folder):
    left, log = repair.handle_outliers(bigints(spark, folder), {"v": repair.REMOVE}, {}, BIGINT_BOUNDS)
    return left.select("o_orderkey", "v", F.lit(log[0]["rows_removed"]).cast("bigint").alias("removed"))


NARROW = [
    "o_orderkey", "CAST(o_orderkey % 121 AS TINYINT) AS tiny", "CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2000000000 ELSE -2000000000 END AS INT) AS whole",
    "CAST(o_orderkey % 1000 AS DECIMAL(5, 2)) AS amount", "CAST(o_orderkey % 121 AS TINYINT) AS tiny_in", "CAST(o_orderkey % 1000 AS DECIMAL(5, 2)) AS amount_in",
]


def cap_narrow(spark, folder):
    """Columns whose quartile fences lie outside their type, and the same with bounds between two of its values."""
    rows = table(spark, folder, "orders").selectExpr(*NARROW)
    actions = dict.fromkeys(("tiny", "whole", "amount", "tiny_in", "amount_in"), repair.CAP)
    capped, log = repair.handle_outliers(rows, actions, {}, {"tiny_in": (10.5, 99.5), "amount_in": (12.345, 600.008)})
    counts = [F.lit(e[side]).cast("bigint").alias(f"{e['column']}_{side}") for e in log if e["column"].endswith("_in") for side in ("capped_below", "capped_above")]
    return capped.select("*", *counts)


def split_events_nokeys(spark, folder):
    parts = split.stratified_split(table(spark, folder, "events"), "event_type")
    return parts.groupBy("event_type", "split").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


def oversample_events_nokeys(spark, folder):
    rows = balance.oversample(table(spark, folder, "events"), "event_type")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


QUERIES = {
    "distinct_decimal": distinct_decimal,
    "duplicates_decimal": duplicates_decimal,
    "encode_target_decimal": encode_target_decimal,
    "cap_bigint": cap_bigint,
    "remove_bigint": remove_bigint,
    "cap_narrow": cap_narrow,
    "split_events_nokeys": split_events_nokeys,
    "oversample_events_nokeys": oversample_events_nokeys,
}

CLASSES = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"

ORACLES = {
    "distinct_decimal": f"SELECT count(*) AS n_unique, max(n)::BIGINT AS top FROM (SELECT amount, count(*) AS n FROM ({DECIMAL_SQL}) GROUP BY amount)",
    "duplicates_decimal": f"SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM ({DECIMAL_SQL}) GROUP BY amount, l_returnflag)",
    "encode_target_decimal": """SELECT l_quantity AS quantity, (dense_rank() OVER (ORDER BY l_quantity) - 1)::DOUBLE AS label, count(*) AS n
        FROM lineitem GROUP BY l_quantity""",
    "cap_bigint": """SELECT o_orderkey, least(greatest(9007199254740993 + 2 * o_orderkey, 9007199254741192), 9007199256740992) AS v FROM orders""",
    "remove_bigint": """SELECT o_orderkey, v, (SELECT count(*) FROM orders) - count(*) OVER () AS removed FROM (SELECT o_orderkey, 9007199254740993 + 2 * o_orderkey AS v FROM orders)
        WHERE v BETWEEN 9007199254741192 AND 9007199256740992""",
    "cap_narrow": f"""WITH t AS (SELECT {', '.join(NARROW)} FROM orders)
        SELECT o_orderkey, tiny, whole, amount, least(greatest(tiny_in, 11), 99) AS tiny_in, least(greatest(amount_in, 12.35), 600.00) AS amount_in,
          count(*) FILTER (tiny_in < 11) OVER () AS tiny_in_capped_below, count(*) FILTER (tiny_in > 99) OVER () AS tiny_in_capped_above,
          count(*) FILTER (amount_in < 12.35) OVER () AS amount_in_capped_below, count(*) FILTER (amount_in > 600) OVER () AS amount_in_capped_above FROM t""",
    "split_events_nokeys": f"""SELECT event_type, split, n, n AS n_ids FROM (
        SELECT event_type, 'test' AS split, round(n * 0.2)::BIGINT AS n FROM ({CLASSES})
        UNION ALL SELECT event_type, 'train', n - round(n * 0.2)::BIGINT FROM ({CLASSES}))""",
    "oversample_events_nokeys": f"""WITH c AS ({CLASSES}), low AS (SELECT * FROM c ORDER BY n, event_type LIMIT 1), high AS (SELECT * FROM c ORDER BY n DESC, event_type LIMIT 1)
        SELECT event_type, n, n AS n_ids FROM high UNION ALL SELECT low.event_type, high.n, low.n FROM low, high""",
}
