"""Data-quality detectors. Each gives issue rows; suggestions follow from the issues by fixed rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.bounds import sides
from tabwright.functions.columns import nan_to_null, quoted
from tabwright.operators.feature_types import (
    CONTINUOUS,
    DISCRETE,
    ENCODED,
    NUMERIC_TYPES,
    TEXT,
    FeatureTypes,
    infer_types,
    of_type,
)
from tabwright.operators.profile import by_column, class_counts, column_moments, fences, modes
from tabwright.operators.states import ColumnState, column_states, top_values

# Issue names, options and thresholds.
MISSING = "Missing Values"
OUTLIERS = "Outliers"
CONSTANT = "Constant Feature"
NEAR_CONSTANT = "Near-Constant Feature"
IMBALANCE = "Class Imbalance"
CARDINALITY = "High Cardinality"
MISSING_HIGH, MISSING_MEDIUM = 50.0, 10.0
OUTLIER_MEDIUM, OUTLIER_HIGH = 0.01, 0.05
NEAR_CONSTANT_SHARE = 0.99
IMBALANCE_RATIO, IMBALANCE_HIGH = 3.0, 10.0
CARDINALITY_VALUES, CARDINALITY_RATIO, CARDINALITY_HIGH = 50, 0.2, 100
CAP, REMOVE, NO_ACTION = "cap (IQR)", "remove", "no action"
MISSING_OPTIONS = {
    "numeric": ("median", ["median", "mean", "constant value"]),
    "text": ("mode", ["mode", "constant value", "drop rows"]),
    "other": ("median", ["median", "mean", "mode", "constant value", "drop rows"]),
}
OUTLIER_OPTIONS = [REMOVE, CAP, NO_ACTION]
CONSTANT_OPTIONS = ("drop feature", ["drop feature", "keep feature"])
IMBALANCE_OPTIONS = ("class_weights", ["class_weights", "undersampling", "oversampling", NO_ACTION])
CARDINALITY_OPTIONS = ("group_rare_categories", ["group_rare_categories", "drop_feature", "keep_as_is"])

ISSUES_SCHEMA = (
    "issue_id string, type string, column string, feature_type string, severity string, count bigint, percent double, "
    "lower double, upper double, top_frequency_percent double, top_value string, imbalance_ratio double, "
    "minority_percent double, unique_values bigint, unique_ratio_percent double"
)
ISSUE_FIELDS = [part.split()[0] for part in ISSUES_SCHEMA.split(", ")]
OUTLIERS_SCHEMA = (
    "column string, feature_type string, count bigint, ratio double, percent double, lower double, upper double, "
    "q1 double, q3 double, iqr double, min double, max double, severity string"
)
SUGGESTIONS_SCHEMA = "issue_id string, type string, column string, recommended string, options array<string>"

Issue = dict


def _issue(**known) -> Issue:
    return {name: known.get(name) for name in ISSUE_FIELDS}


def issues_frame(spark: SparkSession, issues: Sequence[Issue], digits: int = 4) -> DataFrame:
    """Issues as a table; one row per column and kind, so small whatever the data size."""
    table = spark.createDataFrame([Row(**i) for i in issues] if issues else [], ISSUES_SCHEMA)
    rounded = {"percent": 2, "top_frequency_percent": 2, "imbalance_ratio": 2, "minority_percent": 2, "unique_ratio_percent": 2}
    return table.withColumns({name: F.round(name, d) for name, d in rounded.items()} | {b: F.round(b, digits) for b in ("lower", "upper")})


def detect_missing(types: FeatureTypes) -> list[Issue]:
    found = []
    for t in types.values():
        if not t.n_missing:
            continue
        share = 100.0 * t.n_missing / t.n_rows
        severity = "high" if share > MISSING_HIGH else "medium" if share > MISSING_MEDIUM else "low"
        found.append(
            _issue(
                issue_id=f"missing_{t.column}", type=MISSING, column=t.column, feature_type=t.type, severity=severity,
                count=t.n_missing, percent=share,
            )
        )
    return found


def outlier_severity(ratio: float) -> str:
    return "low" if ratio < OUTLIER_MEDIUM else "medium" if ratio < OUTLIER_HIGH else "high"


def outlier_stats(df: DataFrame, types: FeatureTypes, include_discrete: bool = False, all_columns: bool = False) -> list[dict]:
    """Fence statistics of the continuous (and on request discrete) columns that have outliers.

    A column without spread between its quartiles has none by definition.
    """
    df = nan_to_null(df)
    columns = of_type(types, CONTINUOUS, DISCRETE) if include_discrete else of_type(types, CONTINUOUS)
    moments = {c: types[c].moments or column_moments(df, [c])[c] for c in columns}
    usable = [c for c in columns if moments[c].get("count") and moments[c]["q3"] > moments[c]["q1"]]
    bounds = {c: fences(moments[c]["q1"], moments[c]["q3"]) for c in usable}
    if not usable:
        return []
    x = F.col("x")
    outside = {"n": F.count_if((x < F.col("low")) | (x > F.col("high")))}
    limits = {c: dict(low=low, high=high) for c, (low, high) in bounds.items()}
    row = [r["n"] for r in by_column(df, usable, outside, limits)]
    found = []
    for i, c in enumerate(usable):
        m, count = moments[c], row[i]
        if count == 0 and not all_columns:
            continue
        ratio = count / m["count"]
        found.append(
            dict(
                column=c, feature_type=types[c].type, count=count, ratio=ratio, percent=100.0 * ratio,
                lower=bounds[c][0], upper=bounds[c][1], q1=m["q1"], q3=m["q3"], iqr=m["q3"] - m["q1"],
                min=m["min"], max=m["max"], severity=outlier_severity(ratio),
            )
        )
    return found


def outliers_frame(df: DataFrame, types: FeatureTypes, include_discrete: bool = False) -> DataFrame:
    rows = [Row(**s) for s in outlier_stats(df, types, include_discrete)]
    table = df.sparkSession.createDataFrame(rows, OUTLIERS_SCHEMA)
    digits = {"ratio": 4, "percent": 2, "lower": 4, "upper": 4, "q1": 4, "q3": 4, "iqr": 4, "min": 4, "max": 4}
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


def detect_outliers(df: DataFrame, types: FeatureTypes) -> list[Issue]:
    return [
        _issue(
            issue_id=f"outliers_{s['column']}", type=OUTLIERS, column=s["column"], feature_type=s["feature_type"],
            severity=s["severity"], count=s["count"], percent=s["percent"], lower=s["lower"], upper=s["upper"],
        )
        for s in outlier_stats(df, types)
    ]


def outlier_rows(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with a value outside its bounds in any of the given columns."""
    outside = F.lit(False)
    for c, (low, high) in bounds.items():
        below, above = sides(c, low, high, df.schema[c].dataType)
        outside = outside | below | above
    return df.filter(outside)


def detect_constants(df: DataFrame, types: FeatureTypes, threshold: float = NEAR_CONSTANT_SHARE) -> list[Issue]:
    """Columns where one value holds at least ``threshold`` of the non-missing rows."""
    flagged = {}
    for c, t in types.items():
        present = t.n_rows - t.n_missing
        if present and t.top_count / present >= threshold:
            flagged[c] = t.top_count / present
    # One pass finds the values of known hashes; columns whose values were counted apart are counted once more.
    top = top_values(df, {c: types[c].top_hash for c in flagged if types[c].top_hash is not None})
    top |= modes(df, [c for c in flagged if c not in top])
    return [
        _issue(
            issue_id=f"constant_{c}", type=CONSTANT if share == 1.0 else NEAR_CONSTANT, column=c,
            feature_type=types[c].type, severity="high" if share == 1.0 else "medium",
            top_frequency_percent=100.0 * share, top_value=str(top[c]), unique_values=types[c].n_unique,
        )
        for c, share in flagged.items()
    ]


def detect_imbalance(df: DataFrame, target: str | None, state: ColumnState | None = None) -> list[Issue]:
    """Largest against smallest class of the target; from its ``state`` if that has counts."""
    if target is None:
        return []
    if state is not None and state.exact:
        row = (state.least_count, state.top_count, state.present)
    else:
        row = class_counts(df, target).agg(F.min("n"), F.max("n"), F.sum("n")).first()
    if not row[2] or row[1] / row[0] <= IMBALANCE_RATIO:
        return []
    ratio = row[1] / row[0]
    return [
        _issue(
            issue_id="class_imbalance", type=IMBALANCE, column=target,
            severity="high" if ratio > IMBALANCE_HIGH else "medium", imbalance_ratio=ratio,
            minority_percent=100.0 * row[0] / row[2],
        )
    ]


def detect_cardinality(types: FeatureTypes) -> list[Issue]:
    found = []
    for t in types.values():
        if t.type not in (TEXT, ENCODED):
            continue
        if t.n_unique > CARDINALITY_VALUES or t.unique_ratio > CARDINALITY_RATIO:
            found.append(
                _issue(
                    issue_id=f"high_cardinality_{t.column}", type=CARDINALITY, column=t.column, feature_type=t.type,
                    severity="high" if t.n_unique > CARDINALITY_HIGH else "medium", unique_values=t.n_unique,
                    unique_ratio_percent=100.0 * t.unique_ratio,
                )
            )
    return found


def detect_all(
    df: DataFrame, target: str | None = None, types: FeatureTypes | None = None, states: dict[str, ColumnState] | None = None
) -> list[Issue]:
    """Missing values, outliers, constants, imbalance, cardinality, in that order.

    Looks at the table as given: text markers such as ``?`` count as values until they are normalised. Reads the table for
    the column states, the quartiles, the outliers and the names of constant values; once more where a column has many
    different values whose number matters. What is known already, ``types`` and the ``states`` of all columns, is taken as it is.
    """
    df = nan_to_null(df)
    if types is None:
        states = column_states(df) if states is None else states
        types = infer_types(df, target, states=states)
    return (
        detect_missing(types)
        + detect_outliers(df, types)
        + detect_constants(df, types)
        + detect_imbalance(df, target, states[target] if states and target else None)
        + detect_cardinality(types)
    )


def suggestion_for(issue: Issue) -> tuple[str, list[str]]:
    """``(recommended, options)`` of an issue."""
    kind = issue["type"]
    if kind == MISSING:
        feature = issue["feature_type"]
        return MISSING_OPTIONS["numeric" if feature in NUMERIC_TYPES else "text" if feature == TEXT else "other"]
    if kind == OUTLIERS:
        return (NO_ACTION if issue["severity"] == "high" else CAP), OUTLIER_OPTIONS
    if kind == IMBALANCE:
        return IMBALANCE_OPTIONS
    return CARDINALITY_OPTIONS if kind == CARDINALITY else CONSTANT_OPTIONS


def suggestions_frame(spark: SparkSession, issues: Sequence[Issue]) -> DataFrame:
    rows = []
    for issue in issues:
        recommended, options = suggestion_for(issue)
        rows.append((issue["issue_id"], issue["type"], issue["column"], recommended, list(options)))
    return spark.createDataFrame(rows, SUGGESTIONS_SCHEMA)


def issue_summary(issues_table: DataFrame) -> DataFrame:
    """``type, n_issues, columns``."""
    return issues_table.groupBy("type").agg(
        F.count("*").alias("n_issues"), F.concat_ws(",", F.array_sort(F.collect_list("column"))).alias("columns")
    )


def suggestion_of(suggestions_table: DataFrame, issue_id: str) -> DataFrame:
    return suggestions_table.filter(F.col("issue_id") == issue_id)


def issues_of_column(issues_table: DataFrame, column: str) -> DataFrame:
    return issues_table.filter(quoted("column") == column)
