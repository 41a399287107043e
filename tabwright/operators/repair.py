"""Decisions and repairs: imputation, outlier capping or removal, dropping of constants, rare-category grouping.

Every repair is an expression or a filter on the input frame. Statistics that steer it are gathered for all columns
of a stage together, and the log of what was done is a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.bounds import clipped, sides
from tabwright.functions.columns import grouping_key, kind_of, kinds, nan_to_null, number, quoted
from tabwright.functions.lookup import lookup
from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators.feature_types import CONTINUOUS, NUMERIC_TYPES, FeatureTypes, column_groups
from tabwright.operators.prepare import OTHER_CATEGORY
from tabwright.operators.profile import fences, modes
from tabwright.operators.quality import (
    CAP,
    CARDINALITY,
    CARDINALITY_OPTIONS,
    CARDINALITY_VALUES,
    CONSTANT,
    IMBALANCE,
    MISSING,
    NEAR_CONSTANT,
    NO_ACTION,
    OUTLIERS,
    REMOVE,
    Issue,
)
from tabwright.session import cut_lineage

# Names of the logged stages and the replacement for a text column without any value.
STAGE_IMPUTE = "missing_value_imputation"
STAGE_OUTLIERS = "outlier_handling"
STAGE_CONSTANTS = "constant_feature_removal"
STAGE_CARDINALITY = "high_cardinality_handling"
STAGE_IMBALANCE = "class_imbalance_handling"
STAGE_GROUPS = "column_grouping"
NO_MODE = "Unknown"
DROP_ROWS = "drop_rows"
DROP_FEATURE = "drop feature"
GROUP_RARE, DROP_WIDE, KEEP_WIDE = CARDINALITY_OPTIONS[1]
IGNORED = "ignored"
# Categories that stay of a column with too many: with the one for all others it has too many no more.
KEPT_CATEGORIES = CARDINALITY_VALUES - 1
DEFAULT_CONSTANT = {"numeric": "0", "text": "Unknown"}

LOG_SCHEMA = (
    "step int, action string, column string, feature_type string, detail_action string, fill_value string, "
    "values_imputed bigint, lower double, upper double, capped_below bigint, capped_above bigint, rows_removed bigint, "
    "rows_remaining bigint"
)
LOG_FIELDS = [part.split()[0] for part in LOG_SCHEMA.split(", ")]


def log_entry(action: str, column: str | None = None, **known) -> dict:
    return {name: known.get(name) for name in LOG_FIELDS} | {"action": action, "column": column}


def log_frame(spark: SparkSession, log: Sequence[dict]) -> DataFrame:
    stages: dict[str, int] = {}
    rows = []
    for entry in log:
        step = stages.setdefault(entry["action"], len(stages) + 1)
        rows.append(Row(**(entry | {"step": step})))
    return spark.createDataFrame(rows, LOG_SCHEMA)


# ---- decisions -----------------------------------------------------------------------------------------------


def default_choice(issue: Issue) -> str:
    """What is done about an issue nobody decided on."""
    if issue["type"] == MISSING:
        return "median" if issue["feature_type"] in NUMERIC_TYPES else "mode"
    if issue["type"] == OUTLIERS:
        return CAP
    if issue["type"] in (CONSTANT, NEAR_CONSTANT):
        return DROP_FEATURE
    return "class_weights" if issue["type"] == IMBALANCE else IGNORED


def resolve_decisions(
    issues: Sequence[Issue], decisions: Mapping[str, str] | None = None, cardinality: str | None = None
) -> list[dict]:
    """One row per issue with the action to take.

    Cardinality issues are reported but not acted on, unless ``cardinality`` names what is done about those that nobody
    decided on; then decisions about them count, too.
    """
    decisions = decisions or {}
    if cardinality not in (None, *CARDINALITY_OPTIONS[1]):
        raise ValueError(f"no way to handle many categories: {cardinality}")
    out = []
    for issue in issues:
        default = default_choice(issue)
        if issue["type"] == CARDINALITY and cardinality is not None:
            default = cardinality
        chosen = default if default == IGNORED else decisions.get(issue["issue_id"]) or default
        lower, upper = issue["lower"], issue["upper"]
        out.append(
            dict(
                issue_id=issue["issue_id"], type=issue["type"], column=issue["column"], choice=chosen,
                lower=None if lower is None else round(lower, 4), upper=None if upper is None else round(upper, 4),
            )
        )
    return out


def decisions_frame(spark: SparkSession, resolved: Sequence[dict]) -> DataFrame:
    schema = "issue_id string, type string, column string, choice string, lower double, upper double"
    return spark.createDataFrame([Row(**r) for r in resolved], schema)


def choices(resolved: Sequence[dict], *types: str) -> dict[str, str]:
    return {r["column"]: r["choice"] for r in resolved if r["type"] in types}


def imbalance_choice(resolved: Sequence[dict]) -> str:
    return next((r["choice"] for r in resolved if r["type"] == IMBALANCE), NO_ACTION)


# ---- missing values ------------------------------------------------------------------------------------------


def _fill(column: str, data_type: T.DataType, value) -> Column:
    """Column with NULLs replaced; a fraction put into a whole-number column makes it a double column."""
    x = quoted(column)
    if isinstance(value, float) and not value.is_integer() and kind_of(data_type) == "int":
        return F.coalesce(x.cast("double"), F.lit(value))
    return F.coalesce(x, F.lit(value).cast(data_type))


def constant_of(choice: str) -> str | None:
    """The value in ``constant:<value>``; everything after the first colon counts."""
    return choice.split(":", 1)[1] if choice.startswith("constant:") else None


def _strategy(choice: str, kind: str, feature_type: str) -> str:
    """Normal form of a choice: both spellings of an option, and mode where a mean makes no sense."""
    if choice in ("drop rows", DROP_ROWS):
        return DROP_ROWS
    if choice == "constant value":
        return "constant:" + DEFAULT_CONSTANT["numeric" if kind in ("int", "float") else "text"]
    if choice in ("median", "mean") and feature_type not in NUMERIC_TYPES:
        return "mode"
    return choice


def impute(df: DataFrame, config: Mapping[str, str], types: FeatureTypes) -> tuple[DataFrame, list[dict]]:
    """Fill or drop missing values per column.

    ``drop_rows`` filters come first; the fill statistics are those of the rows that remain, all in one pass per kind
    of statistic.
    """
    df = nan_to_null(df)
    kind = kinds(df)
    plan = {
        c: _strategy(choice, kind[c], types[c].type if c in types else "unknown")
        for c, choice in config.items()
        if c in kind
    }
    if not plan:
        return df, []
    dropping = [c for c, s in plan.items() if s == DROP_ROWS]
    log: list[dict] = []
    counts = df.agg(F.count("*"), *[F.sum(quoted(c).isNull().cast("bigint")) for c in plan]).first()
    missing = {c: counts[i + 1] or 0 for i, c in enumerate(plan)}
    if dropping:
        # Rows each column removes, given the columns before it, counted in one pass.
        gone, exprs = F.lit(False), []
        for c in dropping:
            exprs.append(F.count_if(~gone & quoted(c).isNull()))
            gone = gone | quoted(c).isNull()
        removed = df.agg(*[e.alias(str(i)) for i, e in enumerate(exprs)]).first()
        left = counts[0]
        for i, c in enumerate(dropping):
            left -= removed[i]
            if removed[i]:
                log.append(log_entry(STAGE_IMPUTE, c, feature_type=_type(types, c), detail_action=DROP_ROWS,
                                     rows_removed=removed[i], rows_remaining=left))
        df = df.na.drop(subset=dropping)
        others = [c for c in plan if c not in dropping]
        if others:
            row = df.agg(*[F.sum(quoted(c).isNull().cast("bigint")) for c in others]).first()
            missing.update({c: row[i] or 0 for i, c in enumerate(others)})
    fill = fill_values(df, {c: s for c, s in plan.items() if s != DROP_ROWS and missing[c]})
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c, value in fill.items():
        name = "constant" if plan[c].startswith("constant:") else plan[c]
        log.append(log_entry(STAGE_IMPUTE, c, feature_type=_type(types, c), detail_action=name,
                             fill_value=str(value), values_imputed=missing[c]))
    order = {c: i for i, c in enumerate(plan)}
    log.sort(key=lambda e: order[e["column"]])
    if fill:
        df = df.withColumns({c: _fill(c, fields[c], v) for c, v in fill.items()})
    return df, log


def _type(types: FeatureTypes, column: str) -> str:
    return types[column].type if column in types else "unknown"


def fill_values(df: DataFrame, plan: Mapping[str, str]) -> dict[str, object]:
    """``{column: replacement}`` for the strategies median, mean, mode and ``constant:<value>``."""
    kind = kinds(df)
    medians = [c for c, s in plan.items() if s == "median"]
    means = [c for c, s in plan.items() if s == "mean"]
    fill: dict[str, object] = {c: q[0] for c, q in exact_quantiles(df, medians, [0.5]).items()}
    if means:
        row = df.agg(*[F.avg(number(c)) for c in means]).first()
        fill.update({c: row[i] for i, c in enumerate(means)})
    top = modes(df, [c for c, s in plan.items() if s == "mode"])
    fill.update({c: NO_MODE if v is None and kind[c] == "text" else v for c, v in top.items()})
    for c, s in plan.items():
        text = constant_of(s)
        if text is None:
            continue
        if kind[c] in ("int", "float"):
            try:
                fill[c] = float(text)
            except ValueError as error:
                raise ValueError(f"constant {text!r} for numeric column {c} is not a number") from error
        else:
            fill[c] = text
    return {c: fill[c] for c in plan if fill.get(c) is not None}


# ---- outliers and constants ----------------------------------------------------------------------------------


def outlier_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Quartile fences, also for columns without spread."""
    found = exact_quantiles(nan_to_null(df), list(columns), [0.25, 0.75])
    return {c: fences(*q) for c, q in found.items() if q[0] is not None}


def handle_outliers(
    df: DataFrame,
    config: Mapping[str, str],
    types: FeatureTypes,
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Cap or remove values outside their bounds; removal also removes rows where the value is missing.

    Values are compared and capped in the type of their column.
    """
    df = nan_to_null(df)
    kind = kinds(df)
    active = {c: a for c, a in config.items() if kind.get(c) in ("int", "float") and a in (CAP, REMOVE)}
    bounds = dict(bounds or {})
    unknown = [c for c in active if c not in bounds]
    bounds.update(outlier_bounds(df, unknown) if unknown else {})
    active = {c: a for c, a in active.items() if c in bounds}
    if not active:
        return df, []
    # One pass counts what each step does to the rows that the steps before it leave.
    alive, exprs = F.lit(True), [F.count("*")]
    for c, action in active.items():
        below, above = sides(c, *bounds[c], df.schema[c].dataType)
        inside = quoted(c).isNotNull() & ~below & ~above
        exprs += [F.count_if(alive & below), F.count_if(alive & above), F.count_if(alive & ~inside)]
        if action == REMOVE:
            alive = alive & inside
    row = df.agg(*[e.alias(str(i)) for i, e in enumerate(exprs)]).first()
    log, left, capped, kept = [], row[0], {}, F.lit(True)
    for i, (c, action) in enumerate(active.items()):
        low, high = bounds[c]
        below, above, outside = row[3 * i + 1 : 3 * i + 4]
        common = dict(feature_type=_type(types, c), detail_action=action, lower=low, upper=high)
        if action == CAP:
            capped[c] = clipped(c, low, high, df.schema[c].dataType)
            log.append(log_entry(STAGE_OUTLIERS, c, **common, capped_below=below, capped_above=above))
        else:
            left -= outside
            kept = kept & quoted(c).isNotNull()
            for beyond in sides(c, low, high, df.schema[c].dataType):
                kept = kept & ~beyond
            log.append(log_entry(STAGE_OUTLIERS, c, **common, rows_removed=outside, rows_remaining=left))
    if REMOVE in active.values():
        df = df.filter(kept)
    return (df.withColumns(capped) if capped else df), log


def drop_constants(df: DataFrame, config: Mapping[str, str], types: FeatureTypes) -> tuple[DataFrame, list[dict]]:
    dropped = [c for c, action in config.items() if action == DROP_FEATURE and c in df.columns]
    log = [log_entry(STAGE_CONSTANTS, c, feature_type=_type(types, c), detail_action="drop") for c in dropped]
    return df.drop(*dropped), log


def kept_categories(df: DataFrame, column: str, top: int | None = None, min_share: float | None = None) -> DataFrame:
    """``_key, _n, _kept`` of the ``top`` most frequent values, or of those with ``min_share`` of the rows.

    Small by construction: ``top`` values, or at most 1 / share. Long texts are counted by a digest; ties go to the
    smallest key.
    """
    if (top is None) == (min_share is None):
        raise ValueError("give either top or min_share")
    keys = df.select(grouping_key(quoted(column).cast("string")).alias("_key")).filter("_key IS NOT NULL")
    counted = keys.groupBy("_key").agg(F.count("*").alias("_n"))
    if top is not None:
        kept = counted.orderBy(F.desc("_n"), F.col("_key")).limit(top)
    else:
        kept = counted.filter(F.col("_n") >= F.lit(keys.count() * min_share))
    return cut_lineage(kept.withColumn("_kept", F.lit(True)))


def with_kept(df: DataFrame, column: str, kept: DataFrame, other: str = OTHER_CATEGORY) -> DataFrame:
    """The column as text, with ``other`` for all values but those kept; missing values stay missing."""
    marked = lookup(df.withColumn("_key", grouping_key(quoted(column).cast("string"))), kept, ["_key"], "_n")
    value = F.when(quoted(column).isNull() | F.col("_kept"), quoted(column).cast("string")).otherwise(F.lit(other))
    return marked.withColumn(column, value).select(*[quoted(c) for c in df.columns])


def group_rare(
    df: DataFrame, column: str, top: int | None = None, min_share: float | None = None, other: str = OTHER_CATEGORY
) -> DataFrame:
    """Values outside the ``top`` most frequent, or below ``min_share`` of the rows, become ``other``."""
    return with_kept(df, column, kept_categories(df, column, top, min_share), other)


def handle_cardinality(
    df: DataFrame, config: Mapping[str, str], types: FeatureTypes, top: int = KEPT_CATEGORIES
) -> tuple[DataFrame, list[dict]]:
    """Columns with many categories keep the ``top`` most frequent ones, or go, as chosen for each."""
    log: list[dict] = []
    grouped = [c for c, action in config.items() if action == GROUP_RARE and c in df.columns]
    if grouped:
        kept = {c: kept_categories(df, c, top) for c in grouped}
        held = {c: kept[c].agg(F.sum("_n")).first()[0] or 0 for c in grouped}  # one number each
        present = df.agg(*[F.count(quoted(c)) for c in grouped]).first()
        for i, c in enumerate(grouped):
            df = with_kept(df, c, kept[c])
            log.append(log_entry(STAGE_CARDINALITY, c, feature_type=_type(types, c), detail_action=GROUP_RARE, fill_value=OTHER_CATEGORY, values_imputed=present[i] - held[c]))
    dropped = [c for c, action in config.items() if action == DROP_WIDE and c in df.columns]
    log += [log_entry(STAGE_CARDINALITY, c, feature_type=_type(types, c), detail_action=DROP_WIDE) for c in dropped]
    return df.drop(*dropped), log


# ---- all repairs ---------------------------------------------------------------------------------------------


def repair(
    df: DataFrame, resolved: Sequence[dict], types: FeatureTypes
) -> tuple[DataFrame, list[dict]]:
    """Impute, then outliers (continuous columns only, with the bounds of the issues), constants, many categories."""
    log: list[dict] = []
    df, entries = impute(df, choices(resolved, MISSING), types)
    log += entries
    bounds = {r["column"]: (r["lower"], r["upper"]) for r in resolved if r["type"] == OUTLIERS}
    config = {c: a for c, a in choices(resolved, OUTLIERS).items() if c in types and types[c].type == CONTINUOUS}
    df, entries = handle_outliers(df, config, types, bounds)
    log += entries
    df, entries = drop_constants(df, choices(resolved, CONSTANT, NEAR_CONSTANT), types)
    log += entries
    df, entries = handle_cardinality(df, choices(resolved, CARDINALITY), types)
    return df, log + entries


def grouping_entries(types: FeatureTypes) -> list[dict]:
    """Log rows that say in which block each column entered."""
    return [
        log_entry(STAGE_GROUPS, c, feature_type=types[c].type, detail_action=group)
        for group, columns in column_groups(types).items()
        for c in columns
    ]


def prep_summary(original: DataFrame, final: DataFrame, log: Sequence[dict]) -> DataFrame:
    """Rows and columns before and after, and the number of logged stages."""
    before, after = original.count(), final.count()
    rows = [
        (before, after, before - after, len(original.columns), len(final.columns),
         len(original.columns) - len(final.columns), len({e["action"] for e in log}))
    ]
    return original.sparkSession.createDataFrame(
        rows,
        "rows_original bigint, rows_final bigint, rows_removed bigint, columns_original int, columns_final int, "
        "columns_removed int, steps int",
    )
