"""Registered queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog import inputs
from tabwright.catalog.profile_queries import DOCS_KINDS, LINE_NUMBERS, nulls, union_all, with_source
from tabwright.catalog.quality_queries import DOCS_ISSUES, TARGET, docs_sql, docs_types
from tabwright.operators import quality, report

DECISIONS = {"missing_quality": "mode", "outliers_n_chars": "no action", "Missing Values_2": "mean"}
SETTINGS = {"missing_strategy": "median", "scaling_strategy": "MinMaxScaler", "test_size": 0.25}


def report_overview(spark, folder):
    shape = report.overview(inputs.docs(spark, folder), TARGET)
    cells = [F.struct(F.lit(c).alias("setting"), F.col(c).cast("string").alias("value")) for c in shape.columns]
    return shape.select(F.inline(F.array(*cells))).unionByName(report.settings(spark, SETTINGS))


def report_issues(spark, folder):
    docs, types = docs_types(spark, folder)
    return report.issue_decisions(spark, quality.detect_all(docs, TARGET, types), DECISIONS).drop("place")


def report_eda(spark, folder):
    found = report.findings(inputs.docs(spark, folder), TARGET)
    return found.withColumn("value", F.round("value", 2))


QUERIES = {
    "report_overview": report_overview,
    "report_numeric": lambda s, d: report.numeric_findings(inputs.table(s, d, "lineitem"), "l_tax"),
    "report_target": lambda s, d: report.target_findings(inputs.table(s, d, "documents"), "lang"),
    "report_target_range": lambda s, d: report.target_findings(inputs.table(s, d, "events"), "value"),
    "report_eda": report_eda,
    "report_issues": report_issues,
}

DOC_COLUMNS = list(DOCS_KINDS)
DOC_NUMBERS = ["doc_id", "n_chars", "quality", "toxic", "n_gap", "konst"]

ORACLES = {
    "report_overview": "SELECT 'target' AS setting, 'lang' AS value UNION ALL SELECT 'n_rows', count(*)::VARCHAR FROM documents "
    + "".join(f"UNION ALL SELECT '{k}', '{v}' " for k, v in {
        "n_columns": "11", "n_features": "10", "missing_strategy": "median", "outlier_strategy": "N/A", "scaling_strategy": "MinMaxScaler",
        "encoding_strategy": "N/A", "test_size": "25%",
    }.items()),
    "report_numeric": union_all([
        f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std FROM lineitem" for c in LINE_NUMBERS if c != "l_tax"
    ]),
    "report_target": "SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS percent, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM documents GROUP BY lang",
    "report_target_range": "SELECT 'range' AS value, count(value) AS n, NULL::DOUBLE AS percent, round(min(value), 2) AS low, round(max(value), 2) AS high FROM events",
    "report_eda": with_source(
        "t", inputs.DOCS_SQL,
        "SELECT finding, name, round(value, 2) AS value FROM (" + union_all(
            [
                f"SELECT 'missing' AS finding, 'cells' AS name, ({nulls(DOC_COLUMNS)})::DOUBLE AS value FROM t",
                f"SELECT 'missing', 'percent', round(100.0 * ({nulls(DOC_COLUMNS)}) / (count(*) * 11), 2)::DOUBLE FROM t",
                "SELECT 'shape', 'numeric_columns', 6", "SELECT 'shape', 'text_columns', 5",
                "SELECT 'target_count', lang, count(*) FROM t GROUP BY lang",
                "SELECT 'duplicates', 'rows', (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))",
                "SELECT 'duplicates', 'percent', round(100.0 * ((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / (SELECT count(*) FROM t), 2)",
            ]
            + [f"SELECT 'mean', '{c}', round(avg({c}), 2) FROM t" for c in DOC_NUMBERS]
            + [f"SELECT 'std', '{c}', round(stddev_samp({c}), 2) FROM t" for c in DOC_NUMBERS]
        ) + ")",
    ),
    "report_issues": docs_sql(f"""SELECT type, "column", severity, CASE issue_id WHEN 'missing_quality' THEN 'mode' WHEN 'outliers_n_chars' THEN 'no action'
        WHEN 'missing_n_gap' THEN 'mean' ELSE 'Default/No Action' END AS decision FROM ({DOCS_ISSUES})"""),
}
