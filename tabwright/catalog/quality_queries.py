"""Registered queries: issue detectors and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import DOCS_KINDS, LINE_KINDS, only, typed_sql, union_all, with_source
from tabwright.operators import quality
from tabwright.operators.feature_types import infer_types

TARGET = "lang"
LINE_TARGET = "l_returnflag"


def docs_types(spark, folder):
    docs = inputs.docs(spark, folder)
    return docs, infer_types(docs, TARGET)


def docs_issues(spark, folder):
    return quality.issues_frame(spark, quality.detect_all(inputs.docs(spark, folder), TARGET))


def issues_missing(spark, folder):
    _, types = docs_types(spark, folder)
    return quality.issues_frame(spark, quality.detect_missing(types)).select(
        "issue_id", "type", "column", "feature_type", "severity", "count", "percent"
    )


def issues_outliers(spark, folder):
    docs, types = docs_types(spark, folder)
    return quality.issues_frame(spark, quality.detect_outliers(docs, types)).select(
        "issue_id", "type", "column", "feature_type", "severity", "count", "percent", "lower", "upper"
    )


def events_outliers(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id", "event_type", "value", "user_id")
    return quality.outliers_frame(events, infer_types(events, "event_type"))


def outliers_all(spark, folder):
    lines = squeezed(spark, folder)
    return quality.outliers_frame(lines, infer_types(lines), include_discrete=True)


def squeezed(spark, folder):
    """Line items with a discrete column that has outliers: 1..7, and up to 30 on a few rows."""
    return inputs.table(spark, folder, "lineitem").selectExpr(*SQUEEZED)


SQUEEZED = [
    "CAST(CASE WHEN l_orderkey % 40 = 0 THEN 20 + l_linenumber ELSE l_linenumber END AS INT) AS steps",
    "l_extendedprice * l_quantity AS amount",
]
SQUEEZED_SQL = f"SELECT {', '.join(SQUEEZED)} FROM lineitem"
SQUEEZED_KINDS = {"steps": "int", "amount": "float"}


def outliers_flagged(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id", "value")
    types = infer_types(events)
    bounds = {s["column"]: (s["lower"], s["upper"]) for s in quality.outlier_stats(events, types)}
    return quality.outlier_rows(events, bounds)


def issues_constant(spark, folder):
    docs, types = docs_types(spark, folder)
    return quality.issues_frame(spark, quality.detect_constants(docs, types)).select(
        "issue_id", "type", "column", "feature_type", "severity", "top_frequency_percent", "top_value", "unique_values"
    )


def issues_imbalance(spark, folder):
    found = quality.detect_imbalance(inputs.docs(spark, folder), TARGET)
    return quality.issues_frame(spark, found).select("issue_id", "type", "column", "severity", "imbalance_ratio", "minority_percent")


def issues_imbalance_roles(spark, folder):
    found = quality.detect_imbalance(inputs.table(spark, folder, "conversations"), "role")
    return quality.issues_frame(spark, found).select("issue_id", "type", "column", "severity", "imbalance_ratio", "minority_percent")


def issues_cardinality(spark, folder):
    _, types = docs_types(spark, folder)
    return quality.issues_frame(spark, quality.detect_cardinality(types)).select(
        "issue_id", "type", "column", "feature_type", "severity", "unique_values", "unique_ratio_percent"
    )


def issues_lines(spark, folder):
    lines = inputs.lines(spark, folder)
    return quality.issues_frame(spark, quality.detect_all(lines, LINE_TARGET)).select("issue_id", "type", "severity", "feature_type")


def suggestions_all(spark, folder):
    docs, types = docs_types(spark, folder)
    found = quality.suggestions_frame(spark, quality.detect_all(docs, TARGET, types))
    return found.withColumn("options", F.concat_ws("|", "options"))


QUERIES = {
    "issues_missing": issues_missing,
    "issues_outliers": issues_outliers,
    "events_outliers": events_outliers,
    "outliers_all": outliers_all,
    "outliers_flagged": outliers_flagged,
    "issues_constant": issues_constant,
    "issues_imbalance": issues_imbalance,
    "issues_imbalance_roles": issues_imbalance_roles,
    "issues_cardinality": issues_cardinality,
    "issues_all": docs_issues,
    "issues_lines": issues_lines,
    "suggestions_all": suggestions_all,
    "issue_summary": lambda s, d: quality.issue_summary(docs_issues(s, d)),
    "issues_of_column": lambda s, d: quality.issues_of_column(docs_issues(s, d), "n_gap").select("issue_id", "type", "severity"),
    "suggestion_of": lambda s, d: quality.suggestion_of(suggestions_all(s, d), "missing_n_gap"),
}


def missing_sql(typed: str) -> str:
    return (
        "SELECT concat('missing_', col) AS issue_id, 'Missing Values' AS type, col AS \"column\", type AS feature_type, "
        "CASE WHEN 100.0 * n_missing / n_rows > 50 THEN 'high' WHEN 100.0 * n_missing / n_rows > 10 THEN 'medium' ELSE 'low' END AS severity, "
        f"n_missing AS count, round(100.0 * n_missing / n_rows, 2) AS percent FROM ({typed}) WHERE n_missing > 0"
    )


def outliers_sql(source: str, kinds: dict[str, str], types: str = "('continuous_numeric')") -> str:
    """Fence statistics of the columns with outliers."""
    counted = union_all([
        f"SELECT col, type, n_rows - n_missing AS n, q1, q3, lo AS mn, hi AS mx, (SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS k "
        f"FROM typed WHERE col = '{c}' AND type IN {types} AND q3 > q1"
        for c, kind in kinds.items() if kind in ("int", "float")
    ])
    return (
        f"SELECT col AS \"column\", type AS feature_type, k AS count, round(k / n::DOUBLE, 4) AS ratio, round((100.0 * k / n)::DECIMAL(28, 12), 2)::DOUBLE AS percent, "
        "round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper, round(q1, 4) AS q1, round(q3, 4) AS q3, "
        "round(q3 - q1, 4) AS iqr, round(mn, 4) AS min, round(mx, 4) AS max, "
        f"CASE WHEN k / n::DOUBLE < 0.01 THEN 'low' WHEN k / n::DOUBLE < 0.05 THEN 'medium' ELSE 'high' END AS severity FROM ({counted}) WHERE k > 0"
    )


def outlier_issue_sql(source: str, kinds: dict[str, str]) -> str:
    return (
        "SELECT concat('outliers_', \"column\") AS issue_id, 'Outliers' AS type, \"column\", feature_type, severity, count, percent, lower, upper "
        f"FROM ({outliers_sql(source, kinds)})"
    )


def constant_sql(source: str, kinds: dict[str, str]) -> str:
    tops = union_all([
        f"SELECT * FROM (SELECT '{c}' AS c, {c}::VARCHAR AS v, count(*) AS k, sum(count(*)) OVER () AS n, count(*) OVER () AS u, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r = 1"
        for c in kinds
    ])
    return (
        "SELECT concat('constant_', c) AS issue_id, CASE WHEN k = n THEN 'Constant Feature' ELSE 'Near-Constant Feature' END AS type, c AS \"column\", "
        "t.type AS feature_type, CASE WHEN k = n THEN 'high' ELSE 'medium' END AS severity, round(100.0 * k / n, 2) AS top_frequency_percent, "
        f"v AS top_value, u AS unique_values FROM ({tops}) JOIN typed t ON t.col = c WHERE k / n::DOUBLE >= 0.99"
    )


def imbalance_sql(source: str, target: str) -> str:
    return (
        f"SELECT 'class_imbalance' AS issue_id, 'Class Imbalance' AS type, '{target}' AS \"column\", CASE WHEN hi / lo::DOUBLE > 10 THEN 'high' ELSE 'medium' END AS severity, "
        "round(hi / lo::DOUBLE, 2) AS imbalance_ratio, round(100.0 * lo / total, 2) AS minority_percent FROM (SELECT min(n) AS lo, max(n) AS hi, sum(n)::BIGINT AS total "
        f"FROM (SELECT count(*) AS n FROM {source} WHERE {target} IS NOT NULL GROUP BY {target})) WHERE hi / lo::DOUBLE > 3"
    )


CARDINALITY_SQL = (
    "SELECT concat('high_cardinality_', col) AS issue_id, 'High Cardinality' AS type, col AS \"column\", type AS feature_type, "
    "CASE WHEN n_unique > 100 THEN 'high' ELSE 'medium' END AS severity, n_unique AS unique_values, round(100.0 * n_unique / n_rows, 2) AS unique_ratio_percent "
    "FROM typed WHERE type IN ('categorical_text', 'categorical_encoded') AND (n_unique > 50 OR n_unique / n_rows::DOUBLE > 0.2)"
)


def all_issues_sql(source: str, kinds: dict[str, str], target: str) -> str:
    return " UNION ALL BY NAME ".join([
        f"SELECT * FROM ({q})"
        for q in (missing_sql("FROM typed"), outlier_issue_sql(source, kinds), constant_sql(source, kinds), imbalance_sql(source, target), CARDINALITY_SQL)
    ])


def with_types(source: str, sql: str, kinds: dict[str, str], body: str) -> str:
    return with_source(source, f"{sql}), typed AS ({typed_sql(source, kinds)}", body)


DOC_COLUMNS = only(DOCS_KINDS, TARGET)
EVENT_KINDS = {"event_id": "int", "value": "float", "user_id": "int"}


def docs_sql(body: str) -> str:
    return with_types("t", inputs.DOCS_SQL, DOC_COLUMNS, body)


DOCS_ISSUES = all_issues_sql("t", DOC_COLUMNS, TARGET)
SUGGESTIONS = f"""SELECT issue_id, type, "column",
    CASE type WHEN 'Missing Values' THEN CASE WHEN feature_type = 'categorical_text' THEN 'mode' ELSE 'median' END
     WHEN 'Outliers' THEN CASE WHEN severity = 'high' THEN 'no action' ELSE 'cap (IQR)' END WHEN 'Class Imbalance' THEN 'class_weights'
     WHEN 'High Cardinality' THEN 'group_rare_categories' ELSE 'drop feature' END AS recommended,
    CASE type WHEN 'Missing Values' THEN CASE WHEN feature_type IN ('continuous_numeric', 'discrete_numeric') THEN 'median|mean|constant value'
       WHEN feature_type = 'categorical_text' THEN 'mode|constant value|drop rows' ELSE 'median|mean|mode|constant value|drop rows' END
     WHEN 'Outliers' THEN 'remove|cap (IQR)|no action' WHEN 'Class Imbalance' THEN 'class_weights|undersampling|oversampling|no action'
     WHEN 'High Cardinality' THEN 'group_rare_categories|drop_feature|keep_as_is' ELSE 'drop feature|keep feature' END AS options
    FROM ({DOCS_ISSUES})"""

ORACLES = {
    "issues_missing": docs_sql(missing_sql("FROM typed")),
    "issues_outliers": docs_sql(outlier_issue_sql("t", DOC_COLUMNS)),
    "events_outliers": with_types("t", "SELECT event_id, event_type, value, user_id FROM events", EVENT_KINDS, outliers_sql("t", EVENT_KINDS)),
    "outliers_all": with_types("t", SQUEEZED_SQL, SQUEEZED_KINDS, outliers_sql("t", SQUEEZED_KINDS, "('continuous_numeric', 'discrete_numeric')")),
    "outliers_flagged": "SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
    "issues_constant": docs_sql(constant_sql("t", DOC_COLUMNS)),
    "issues_imbalance": imbalance_sql("documents", TARGET),
    "issues_imbalance_roles": imbalance_sql("conversations", "role"),
    "issues_cardinality": docs_sql(CARDINALITY_SQL),
    "issues_all": docs_sql(
        "SELECT issue_id, type, \"column\", feature_type, severity, count, percent, lower, upper, top_frequency_percent, top_value, imbalance_ratio, "
        f"minority_percent, unique_values, unique_ratio_percent FROM ({DOCS_ISSUES})"
    ),
    "issues_lines": with_types(
        "t", inputs.LINE_SQL, only(LINE_KINDS, LINE_TARGET),
        f"SELECT issue_id, type, severity, feature_type FROM ({all_issues_sql('t', only(LINE_KINDS, LINE_TARGET), LINE_TARGET)})",
    ),
    "suggestions_all": docs_sql(SUGGESTIONS),
    "issue_summary": docs_sql(f"SELECT type, count(*) AS n_issues, string_agg(\"column\", ',' ORDER BY \"column\") AS columns FROM ({DOCS_ISSUES}) GROUP BY type"),
    "issues_of_column": docs_sql(f"SELECT issue_id, type, severity FROM ({DOCS_ISSUES}) WHERE \"column\" = 'n_gap'"),
    "suggestion_of": docs_sql(f"SELECT * FROM ({SUGGESTIONS}) WHERE issue_id = 'missing_n_gap'"),
}
