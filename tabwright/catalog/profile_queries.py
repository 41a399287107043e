"""Registered queries: scans, profile, feature types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.operators import feature_types as ft
from tabwright.operators import profile
from tabwright.operators.cleaning import MISSING_MARKERS, normalize_missing
from tabwright.sources.tables import union_presplit

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_KINDS = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "text", "l_linestatus": "text",
    "l_shipdate": "other", "l_big": "bool", "l_step": "int", "l_gap": "float", "l_line_gap": "int",
    "l_status_gap": "text", "l_big_gap": "bool",
}
DOCS_KINDS = {
    "doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int", "quality": "int", "toxic": "int",
    "n_gap": "int", "source_gap": "text", "konst": "int", "near": "text",
}
CUSTOMER_KINDS = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"}


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def types_sql(columns) -> str:
    """``name:type,...`` with the type names of Spark."""
    name = "CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(typeof(any_value({c}))) END"
    return " || ',' || ".join(f"'{c}:' || {name.format(c=c)}" for c in columns)


def stats_sql(source: str, kinds: dict[str, str], examples: bool = False) -> str:
    """Per column: counts, range and moments, in column order."""
    parts = []
    for c, kind in kinds.items():
        number = kind in ("int", "float")
        x = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
        sample = (
            f"(SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3))"
            if examples and kind == "text"
            else "''"
        )
        parts.append(
            f"SELECT '{c}' AS col, '{kind}' AS kind, count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, "
            f"count(*) - count({c}) AS n_missing, min({x}) AS lo, max({x}) AS hi, avg({x}) AS mean, "
            f"quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS sd, quantile_cont({x}, 0.25) AS q1, "
            f"quantile_cont({x}, 0.75) AS q3, {sample} AS examples FROM {source}"
        )
    return union_all(parts)


def typed_sql(source: str, kinds: dict[str, str], examples: bool = False) -> str:
    """The statistics with the type of each column."""
    return f"""
    SELECT *, CASE
        WHEN kind2 = 'bool' THEN 'binary'
        WHEN kind2 = 'text' AND n_unique >= 0.95 * n_rows THEN 'id_like'
        WHEN kind2 = 'text' THEN 'categorical_text'
        WHEN n_unique = 2 THEN 'binary'
        WHEN kind2 = 'int' AND n_unique >= 0.95 * n_rows THEN 'id_like'
        WHEN kind2 = 'int' AND n_unique <= 10 THEN 'categorical_encoded'
        WHEN kind2 = 'int' AND (n_unique > 20 OR hi - lo > 50) THEN 'continuous_numeric'
        WHEN kind2 = 'int' THEN 'discrete_numeric'
        WHEN kind2 = 'float' AND n_unique <= 15 THEN 'categorical_encoded'
        WHEN kind2 = 'float' THEN 'continuous_numeric'
        ELSE 'unknown' END AS type
    FROM (SELECT *, CASE WHEN n_missing > 0 AND kind = 'int' THEN 'float' WHEN n_missing > 0 AND kind = 'bool' THEN 'text' ELSE kind END AS kind2
          FROM ({stats_sql(source, kinds, examples)}))
    """


def with_source(name: str, sql: str, body: str) -> str:
    return f"WITH {name} AS ({sql})\n{body}"


def only(kinds: dict[str, str], *dropped: str) -> dict[str, str]:
    return {c: k for c, k in kinds.items() if c not in dropped}


def feature_types_query(spark, folder):
    table = ft.feature_types(inputs.lines(spark, folder), "l_returnflag")
    return _typed_columns(table)


def feature_types_docs_query(spark, folder):
    return _typed_columns(ft.feature_types(inputs.docs(spark, folder), "lang"))


def _typed_columns(table):
    numbers = ["min", "max", "range", "mean", "median", "std", "q1", "q3"]
    return table.select(
        "column", "type", "n_rows", "n_unique", "n_missing", "unique_ratio", *[F.round(c, 3).alias(c) for c in numbers],
        F.concat_ws("|", "examples").alias("examples"),
    )


def typed_output_sql(source_name: str, source: str, kinds: dict[str, str]) -> str:
    moment = "CASE WHEN type IN ('continuous_numeric', 'discrete_numeric') THEN round({0}, 3) END"
    names = {"min": "lo", "max": "hi", "range": "hi - lo", "mean": "mean", "median": "median", "std": "sd", "q1": "q1", "q3": "q3"}
    columns = ", ".join(f'{moment.format(x)} AS "{n}"' for n, x in names.items())
    return with_source(
        source_name, source,
        f'SELECT col AS "column", type, n_rows, n_unique, n_missing, round((n_unique / n_rows::DOUBLE)::DECIMAL(28, 12), 4)::DOUBLE AS unique_ratio, '
        f"{columns}, examples FROM ({typed_sql(source_name, kinds, examples=True)})",
    )


def presplit_union(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return union_presplit(orders.filter("o_orderkey % 5 <> 0"), orders.filter("o_orderkey % 5 = 0"))


def columns_by_type(spark, folder):
    types = ft.infer_types(inputs.lines(spark, folder), "l_returnflag")
    return ft.types_frame(spark, types).filter(F.col("type") == ft.CONTINUOUS).select("column", "type")


def column_groups(spark, folder):
    return ft.column_groups_frame(spark, ft.infer_types(inputs.lines(spark, folder), "l_returnflag"))


def drop_id_like(spark, folder):
    customers = inputs.table(spark, folder, "customer")
    return ft.drop_unusable(customers, ft.infer_types(customers))


def feature_type_summary(spark, folder):
    return ft.type_summary(ft.types_frame(spark, ft.infer_types(inputs.lines(spark, folder), "l_returnflag")))


def datetime_ratio(spark, folder):
    orders = inputs.table(spark, folder, "orders").selectExpr(
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "o_orderstatus",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS mixed",
    )
    return ft.timestamp_shares(orders, ["day", "o_orderstatus", "mixed"])


QUERIES = {
    "scan_preview": lambda s, d: profile.preview(
        inputs.table(s, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("string")), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    ),
    "presplit_union": presplit_union,
    "normalize_missing": lambda s, d: normalize_missing(inputs.marked(s, d)),
    "basic_stats": lambda s, d: profile.basic_stats(inputs.docs(s, d)),
    "global_missing": lambda s, d: profile.global_missing(inputs.docs(s, d)),
    "missing_by_column": lambda s, d: profile.missing_by_column(inputs.docs(s, d)),
    "summary_stats": lambda s, d: profile.summary_stats(inputs.table(s, d, "lineitem")),
    "class_distribution": lambda s, d: profile.class_distribution(inputs.table(s, d, "documents"), "lang"),
    "eda_outliers": lambda s, d: profile.eda_outliers(inputs.table(s, d, "events").select("user_id", "value")),
    "eda_outliers_lines": lambda s, d: profile.eda_outliers(inputs.lines(s, d), "l_tax"),
    "box_summary": lambda s, d: profile.box_summary(inputs.table(s, d, "lineitem"), "l_tax"),
    "correlation_matrix": lambda s, d: profile.correlation_matrix(inputs.lines(s, d)),
    "histogram": lambda s, d: profile.histogram(inputs.table(s, d, "lineitem")),
    "histogram_normal": lambda s, d: profile.histogram_normal(inputs.table(s, d, "events").select("value")),
    "top_categories": lambda s, d: profile.top_categories(inputs.table(s, d, "part")),
    "split_summary": lambda s, d: profile.split_summary(inputs.table(s, d, "orders"), 0.2),
    "value_counts_long": lambda s, d: profile.value_counts_long(inputs.docs(s, d), ["quality", "toxic", "lang", "source_gap"]),
    "duplicate_rows": lambda s, d: profile.duplicate_rows(inputs.repeats(s, d)),
    "duplicate_documents": lambda s, d: profile.duplicate_rows(inputs.table(s, d, "documents").select("text")),
    "profile_table": lambda s, d: profile.profile_table(inputs.table(s, d, "part"), "p_brand").withColumn("value", F.round("value", 3)),
    "feature_types": feature_types_query,
    "feature_types_docs": feature_types_docs_query,
    "columns_by_type": columns_by_type,
    "column_groups": column_groups,
    "drop_id_like": drop_id_like,
    "feature_type_summary": feature_type_summary,
    "datetime_ratio": datetime_ratio,
}


def summary_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"{c}::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({x}), 3) AS mean, round(stddev_samp({x}), 3) AS std, "
            f"round(min({x}), 3) AS min, round(quantile_cont({x}, 0.25), 3) AS q1, round(quantile_cont({x}, 0.5), 3) AS median, "
            f"round(quantile_cont({x}, 0.75), 3) AS q3, round(max({x}), 3) AS max FROM {source}"
        )
    return union_all(parts)


def missing_sql(source: str, columns: list[str]) -> str:
    return union_all([
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS percent FROM {source}"
        for c in columns
    ])


def nulls(columns) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in columns)


def eda_outliers_sql(source: str, columns: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", count(*) FILTER (x < lo OR x > hi) AS iqr_outliers,
        count(*) FILTER (sd > 0 AND abs(x - mean) / nullif(sd, 0) > 3) AS z_outliers, round(any_value(lo), 3) AS lower, round(any_value(hi), 3) AS upper
        FROM (SELECT {c}::DOUBLE AS x FROM {source}),
        (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mean, sd FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,
         quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}::DOUBLE) AS mean, stddev_pop({c}::DOUBLE) AS sd FROM {source}))"""
        for c in columns
    ])


def box_sql(source: str, columns: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", round(min(x), 4) AS min, round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
        round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
        round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, round(max(x), 4) AS max
        FROM (SELECT {c}::DOUBLE AS x FROM {source}), (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
        quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})"""
        for c in columns
    ])


def correlation_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 4) AS correlation FROM {source}"
        for a in columns for b in columns
    ]
    return union_all(parts)


def histogram_sql(source: str, columns: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", bin, round(any_value(low) + (bin - 1) * any_value(width), 4) AS lower,
        round(any_value(low) + (bin - 1) * any_value(width) + any_value(width), 4) AS upper, count(*) AS n
        FROM (SELECT low, width, least(floor((x - low) / width) + 1, 30)::INT AS bin FROM (SELECT {c}::DOUBLE AS x FROM {source} WHERE {c} IS NOT NULL),
        (SELECT min({c})::DOUBLE AS low, (max({c}::DOUBLE) - min({c}::DOUBLE)) / 30 AS width FROM {source})) GROUP BY bin"""
        for c in columns
    ])


def top_sql(source: str, columns: list[str]) -> str:
    return union_all([
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS place
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 10"""
        for c in columns
    ])


def melt_sql(source: str, section: str, name: str, metrics: list[str]) -> str:
    return union_all([f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, \"{m}\"::DOUBLE AS value FROM ({source})" for m in metrics])


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
PART_TEXTS = ["p_name", "p_brand", "p_type"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
DUPLICATES_SQL = (
    "SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicates, round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_percent "
    "FROM (SELECT count(*) AS n FROM ({0}) GROUP BY ALL)"
)
PART_DUPLICATES = "SELECT n_rows, n_rows - d AS duplicates, round(100.0 * (n_rows - d) / n_rows, 2) AS duplicate_percent FROM (SELECT (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS d)"

ORACLES = {
    "scan_preview": "SELECT * REPLACE (l_shipdate::TIMESTAMP::VARCHAR AS l_shipdate) FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 5",
    "presplit_union": "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders",
    "normalize_missing": with_source(
        "m", inputs.MARKED_SQL,
        "SELECT c_custkey, c_acctbal, "
        + ", ".join(
            f"CASE WHEN lower(trim({c})) NOT IN ({', '.join(repr(m) for m in MISSING_MARKERS)}) THEN trim({c}) END AS {c}"
            for c in ("segment", "name")
        )
        + " FROM m",
    ),
    "basic_stats": with_source(
        "t", inputs.DOCS_SQL,
        f"SELECT count(*) AS n_rows, 11 AS n_columns, 6 AS n_numeric, 5 AS n_categorical, round(100.0 * ({nulls(DOCS_KINDS)}) / (count(*) * 11), 2) AS missing_percent, "
        f"{types_sql(DOCS_KINDS)} AS column_types FROM t",
    ),
    "global_missing": with_source(
        "t", inputs.DOCS_SQL,
        f"SELECT ({nulls(DOCS_KINDS)})::BIGINT AS missing_cells, (count(*) * 11)::BIGINT AS total_cells, round(100.0 * ({nulls(DOCS_KINDS)}) / (count(*) * 11), 2) AS missing_percent FROM t",
    ),
    "missing_by_column": with_source("t", inputs.DOCS_SQL, missing_sql("t", list(DOCS_KINDS))),
    "summary_stats": summary_sql("lineitem", LINE_NUMBERS),
    "class_distribution": "SELECT lang AS label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang",
    "eda_outliers": eda_outliers_sql("events", ["user_id", "value"]),
    "eda_outliers_lines": with_source(
        "t", inputs.LINE_SQL,
        eda_outliers_sql("t", [c for c in LINE_NUMBERS if c != "l_tax"] + ["l_step", "l_gap", "l_line_gap"]),
    ),
    "box_summary": box_sql("lineitem", [c for c in LINE_NUMBERS if c != "l_tax"]),
    "correlation_matrix": with_source("t", inputs.LINE_SQL, correlation_sql("t", LINE_NUMBERS + ["l_step", "l_gap", "l_line_gap"])),
    "histogram": histogram_sql("lineitem", LINE_NUMBERS),
    "histogram_normal": """SELECT 'value' AS "column", bin::INT AS bin, round(c, 4) AS centre,
        round(exp(-0.5 * ((c - mean) / sd) * ((c - mean) / sd)) / (sd * sqrt(2 * pi())), 8) AS density
        FROM (SELECT bin, low + (bin - 0.5) * width AS c, mean, sd FROM (SELECT min(value) AS low, (max(value) - min(value)) / 30 AS width,
        avg(value) AS mean, stddev_samp(value) AS sd FROM events), (SELECT unnest(range(1, 31)) AS bin))""",
    "top_categories": top_sql("part", PART_TEXTS),
    "split_summary": """SELECT total, train, total - train AS test, round(100.0 * train / total, 2) AS train_percent,
        round(100.0 * (total - train) / total, 2) AS test_percent FROM (SELECT count(*) AS total, floor(count(*) * 0.8::DOUBLE)::BIGINT AS train FROM orders)""",
    "value_counts_long": with_source(
        "t", inputs.DOCS_SQL,
        union_all([f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("quality", "toxic", "lang", "source_gap")]),
    ),
    "duplicate_rows": DUPLICATES_SQL.format(inputs.REPEATS_SQL).replace("SELECT count(*) AS n FROM", "SELECT event_type, user_group, count(*) AS n FROM"),
    "duplicate_documents": "SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS duplicates, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 2) AS duplicate_percent FROM documents",
    "profile_table": "SELECT section, name, metric, round(value, 3) AS value FROM ("
    + union_all([
        melt_sql(f"SELECT count(*) AS n_rows, 6 AS n_columns, 3 AS n_numeric, 3 AS n_categorical, round(100.0 * ({nulls(PART_COLUMNS)}) / (count(*) * 6), 2) AS missing_percent FROM part",
                 "overview", "'table'", ["n_rows", "n_columns", "n_numeric", "n_categorical", "missing_percent"]),
        melt_sql(summary_sql("part", PART_NUMBERS), "variables", '"column"', ["count", "mean", "std", "min", "q1", "median", "q3", "max"]),
        melt_sql(missing_sql("part", PART_COLUMNS), "missing", '"column"', ["missing", "percent"]),
        melt_sql(correlation_sql("part", PART_NUMBERS), "correlations", "concat(a, '~', b)", ["correlation"]),
        melt_sql(PART_DUPLICATES, "duplicates", "'table'", ["duplicates", "duplicate_percent"]),
        melt_sql(top_sql("part", PART_TEXTS), "categories", "concat(\"column\", '=', value)", ["n"]),
        melt_sql("SELECT p_brand AS label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS percent FROM part GROUP BY p_brand", "classes", "label", ["n", "percent"]),
    ]) + ")",
    "feature_types": typed_output_sql("t", inputs.LINE_SQL, only(LINE_KINDS, "l_returnflag")),
    "feature_types_docs": typed_output_sql("t", inputs.DOCS_SQL, only(DOCS_KINDS, "lang")),
    "columns_by_type": with_source("t", inputs.LINE_SQL, f"SELECT col AS \"column\", type FROM ({typed_sql('t', only(LINE_KINDS, 'l_returnflag'))}) WHERE type = 'continuous_numeric'"),
    "column_groups": with_source(
        "t", inputs.LINE_SQL,
        f"""SELECT col AS "column", CASE WHEN type IN ('continuous_numeric', 'discrete_numeric') THEN 'numeric'
        WHEN type IN ('categorical_text', 'categorical_encoded', 'binary') THEN 'categorical' WHEN type = 'id_like' THEN 'dropped_id_like'
        ELSE 'left_out' END AS "group" FROM ({typed_sql('t', only(LINE_KINDS, 'l_returnflag'))})""",
    ),
    "drop_id_like": "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "feature_type_summary": with_source(
        "t", inputs.LINE_SQL,
        f"SELECT type, count(*) AS n_columns, string_agg(col, ',' ORDER BY col) AS columns FROM ({typed_sql('t', only(LINE_KINDS, 'l_returnflag'))}) GROUP BY type",
    ),
    "datetime_ratio": "SELECT col AS \"column\", n AS \"values\", parsed, round(parsed / n::DOUBLE, 4) AS ratio FROM ("
    + union_all([
        f"SELECT '{name}' AS col, count({x}) AS n, count(TRY_CAST({x} AS TIMESTAMP)) AS parsed FROM orders"
        for name, x in {
            "day": "(o_orderdate::DATE)::VARCHAR", "o_orderstatus": "o_orderstatus",
            "mixed": "(CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE (o_orderdate::DATE)::VARCHAR END)",
        }.items()
    ]) + ")",
}
