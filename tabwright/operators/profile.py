"""Table profile: counts, missing shares, moments, quantiles, class mix, correlations, histograms, duplicates.

Wide statistics come from one aggregation over all columns; per-value statistics come from one grouped count over
(column, value) pairs, which feeds distinct counts, top values and modes alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    columns_of_kind,
    kinds,
    nan_to_null,
    number,
    numeric_columns,
    percent,
    quoted,
    slot_of,
    text_columns,
    typed_key,
)
from tabwright.functions.quantiles import DIRECT_ROWS, exact_quantiles
from tabwright.operators.states import ColumnState, column_states

# Fixed values of the profile.
HISTOGRAM_BINS = 30
TOP_CATEGORIES = 10
FENCE = 1.5
Z_LIMIT = 3.0
QUARTILES = (0.25, 0.5, 0.75)


def long_rows(row_frame: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row with columns ``<field>_<i>`` to one row per column."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return row_frame.select(F.inline(F.array(*structs)))


def by_column(
    df: DataFrame, columns: Sequence[str], aggregates: dict[str, Column], constants: dict[str, dict[str, float]] | None = None
) -> list[Row]:
    """Aggregates of each column: rows ``cid`` (position in ``columns``) and one field per aggregate.

    Aggregates are written over ``x``, the column as a number (0 for a present value that is none), and over the named
    ``constants`` of the column. The columns are stacked under each other in one scan. One aggregation with a set of
    buffers per column would do the same, but its generated code grows with the table's width until it is no longer
    compiled.
    """
    kind = kinds(df)
    cells = []
    for i, c in enumerate(columns):
        x = number(c) if kind[c] in ("int", "float") else F.when(quoted(c).isNotNull(), F.lit(0.0))
        own = [F.lit(v).cast("double").alias(n) for n, v in (constants or {}).get(c, {}).items()]
        cells.append(F.struct(F.lit(i).alias("cid"), x.alias("x"), *own))
    if not cells:
        return []
    long = nan_to_null(df.select(*[quoted(c) for c in columns])).select(F.inline(F.array(*cells)))
    found = long.groupBy("cid").agg(*[e.alias(n) for n, e in aggregates.items()]).collect()  # one row per column
    return sorted(found, key=lambda row: row["cid"])


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, digest: bool = False) -> DataFrame:
    """``cid, as_long, as_double, as_text, n``: count per column (by position) and non-missing value.

    Columns of one kind are stacked and counted together, so keys are narrow and keep their type. ``digest`` replaces
    long text by a digest key; enough for counting, and far less to shuffle.
    """
    columns = list(columns if columns is not None else df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    df = nan_to_null(df.select(*[quoted(c) for c in columns]))
    slots = {"as_long": "bigint", "as_double": "double", "as_text": "string"}
    out = None
    for slot, dtype in slots.items():
        own = {c: i for i, c in enumerate(columns) if slot_of(fields[c]) == slot}
        if not own:
            continue
        stacked = df.select(*[typed_key(c, fields[c], digest).alias(str(i)) for c, i in own.items()]).unpivot(
            [], [str(i) for i in own.values()], "cid", "value"
        )
        counted = stacked.filter("value IS NOT NULL").groupBy("cid", "value").agg(F.count("*").alias("n"))
        part = counted.select(
            F.col("cid").cast("int").alias("cid"),
            *[(F.col("value") if s == slot else F.lit(None).cast(t)).alias(s) for s, t in slots.items()],
            "n",
        )
        out = part if out is None else out.unionByName(part)
    return out


def distinct_stats(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[int, int]]:
    """``{column: (distinct values, count of the most frequent one)}``."""
    columns = list(columns if columns is not None else df.columns)
    rows = (
        value_counts(df, columns, digest=True)
        .groupBy("cid")
        .agg(F.count("*").alias("n_unique"), F.max("n").alias("top"))
        .collect()
    )
    found = {columns[r["cid"]]: (r["n_unique"], r["top"]) for r in rows}
    return {c: found.get(c, (0, 0)) for c in columns}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value per column, the smallest one on ties; None for an all-missing column."""
    columns = list(columns)
    if not columns:
        return {}
    counted = value_counts(df, columns)
    top = counted.groupBy("cid").agg(F.max("n").alias("n"))  # one row per column
    exact = {i: df.schema[c].dataType for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.DecimalType)}
    decimals = [F.min(F.when(F.col("cid") == i, F.col("as_text")).cast(t)) for i, t in exact.items()]
    best = (
        counted.join(F.broadcast(top), ["cid", "n"])
        .groupBy("cid")
        .agg(*decimals, F.min("as_long"), F.min("as_double"), F.min("as_text"))
        .collect()
    )
    found = {columns[r[0]]: next((v for v in r[1:] if v is not None), None) for r in best}
    kind = kinds(df)
    return {
        c: (found.get(c) == "true") if kind[c] == "bool" and found.get(c) is not None else found.get(c)
        for c in columns
    }


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` with values as text."""
    names = F.array(*[F.lit(c) for c in columns])
    value = F.coalesce(F.col("as_long").cast("string"), F.col("as_double").cast("string"), F.col("as_text"))
    return value_counts(df, columns).select(names[F.col("cid")].alias("column"), value.alias("value"), "n")


# ---- counts and missing values -------------------------------------------------------------------------------


def _null_counts(df: DataFrame) -> Column:
    return sum((F.sum(quoted(c).isNull().cast("bigint")) for c in df.columns), F.lit(0).cast("bigint"))


def global_missing(df: DataFrame) -> DataFrame:
    """``missing_cells, total_cells, missing_percent`` (2 digits, 0 for an empty table)."""
    df = nan_to_null(df)
    cells = F.count("*") * F.lit(len(df.columns))
    missing = F.coalesce(_null_counts(df), F.lit(0).cast("bigint"))
    return df.agg(
        missing.alias("missing_cells"), cells.alias("total_cells"), percent(missing, cells, 2).alias("missing_percent")
    )


def types_text(df: DataFrame) -> str:
    """``name:type,...`` in column order."""
    return ",".join(f"{name}:{dtype}" for name, dtype in df.dtypes)


def basic_stats(df: DataFrame, states: dict[str, ColumnState] | None = None) -> DataFrame:
    """Shape of the table, with its column types as one text ``name:type,...``."""
    n = len(df.columns)
    if states is None:
        shape = global_missing(df).withColumn("n_rows", F.try_divide("total_cells", F.lit(n)).cast("bigint"))
    else:
        cells, missing = sum(s.n for s in states.values()), sum(s.missing for s in states.values())
        shape = df.sparkSession.createDataFrame([(cells // max(1, n), missing, cells)], "n_rows bigint, missing_cells bigint, total_cells bigint")
        shape = shape.withColumn("missing_percent", percent(F.col("missing_cells"), F.col("total_cells"), 2))
    return shape.select(
        "n_rows",
        F.lit(n).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(text_columns(df))).alias("n_categorical"),
        "missing_percent",
        F.lit(types_text(df)).alias("column_types"),
    )


def missing_by_column(df: DataFrame, states: dict[str, ColumnState] | None = None) -> DataFrame:
    """``column, missing, percent``, most missing first."""
    if states is not None:
        rows = [(c, s.missing, s.n) for c, s in states.items()]
        table = df.sparkSession.createDataFrame(rows, "column string, missing bigint, n bigint")
        return table.select("column", "missing", percent(F.col("missing"), F.col("n"), 2).alias("percent")).orderBy(F.desc("percent"), "column")
    df = nan_to_null(df)
    wide = df.agg(
        *[F.sum(quoted(c).isNull().cast("bigint")).alias(f"missing_{i}") for i, c in enumerate(df.columns)],
        *[percent(F.sum(quoted(c).isNull().cast("bigint")), F.count("*"), 2).alias(f"percent_{i}") for i, c in enumerate(df.columns)],
    )
    return long_rows(wide, df.columns, ["missing", "percent"]).orderBy(F.desc("percent"), "column")


# ---- moments and quantiles -----------------------------------------------------------------------------------


def table_moments(df: DataFrame, numeric: Sequence[str]) -> tuple[int, dict[str, int], dict[str, dict]]:
    """Row count, missing count per column, and ``dict(count, mean, std, std_pop, min, max)`` per numeric column."""
    x = F.col("x")
    rows = by_column(
        df, df.columns,
        {"n": F.count("*"), "present": F.count(x), "mean": F.avg(x), "std_pop": F.stddev_pop(x), "low": F.min(x), "high": F.max(x)},
    )
    n_rows, missing, stats = (rows[0]["n"] if rows else 0), dict.fromkeys(df.columns, 0), {}
    for r in rows:
        missing[df.columns[r["cid"]]] = r["n"] - r["present"]
    seen = {df.columns[r["cid"]]: r for r in rows}
    for c in numeric:
        r = seen.get(c)
        n = r["present"] if r else 0
        std = r["std_pop"] * math.sqrt(n / (n - 1)) if n > 1 else None
        stats[c] = dict(
            count=n, mean=r["mean"] if r else None, std=std, std_pop=r["std_pop"] if r else None,
            min=r["low"] if r else None, max=r["high"] if r else None,
        )
    return n_rows, missing, stats


def add_quartiles(df: DataFrame, stats: dict[str, dict], columns: Sequence[str], n_rows: int, direct_rows: int = DIRECT_ROWS):
    """Put q1, median and q3 of the given columns into ``stats``."""
    counts = {c: stats[c]["count"] for c in columns}
    found = exact_quantiles(nan_to_null(df), list(columns), QUARTILES, n_rows, counts, direct_rows)
    for c, q in found.items():
        stats[c].update(q1=q[0], median=q[1], q3=q[2])


def column_moments(df: DataFrame, columns: Sequence[str], direct_rows: int = DIRECT_ROWS) -> dict[str, dict]:
    """``{column: dict(count, mean, std, std_pop, min, max, q1, median, q3)}`` for numeric columns."""
    columns = list(columns)
    if not columns:
        return {}
    narrow = df.select(*[quoted(c) for c in columns])
    n_rows, _, stats = table_moments(narrow, columns)
    add_quartiles(narrow, stats, columns, n_rows, direct_rows)
    return stats


SUMMARY_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, q1 double, median double, q3 double, max double"
)


def summary_stats(df: DataFrame, digits: int = 3, states: dict[str, ColumnState] | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per numeric column."""
    numeric = numeric_columns(df)
    if states is None:
        stats = column_moments(df, numeric)
    else:
        stats = {c: dict(states[c].moments) for c in numeric}
        add_quartiles(df, stats, numeric, max((states[c].n for c in numeric), default=0))
    names = ["count", "mean", "std", "min", "q1", "median", "q3", "max"]
    rows = [(c, *[s[n] for n in names]) for c, s in stats.items()]
    table = df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    return table.select("column", "count", *[F.round(n, digits).alias(n) for n in names[1:]])


def fences(q1: float, q3: float) -> tuple[float, float]:
    spread = q3 - q1
    return q1 - FENCE * spread, q3 + FENCE * spread


def eda_outliers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Per numeric column: values outside the quartile fences and values with |z| > 3 (population std)."""
    columns = numeric_columns(df, exclude=[target])
    stats = {c: s for c, s in column_moments(df, columns).items() if s["count"]}
    limits = {c: fences(s["q1"], s["q3"]) for c, s in stats.items()}
    constants = {c: dict(low=limits[c][0], high=limits[c][1], mean=s["mean"], std=s["std_pop"]) for c, s in stats.items()}
    x, z = F.col("x"), F.try_divide(F.abs(F.col("x") - F.col("mean")), F.col("std"))
    found = by_column(
        df, list(stats),
        {"iqr": F.count_if((x < F.col("low")) | (x > F.col("high"))), "z": F.count_if(z > Z_LIMIT)}, constants,
    )
    names = list(stats)
    rows = [(names[r["cid"]], r["iqr"], r["z"], *limits[names[r["cid"]]]) for r in found]
    table = df.sparkSession.createDataFrame(rows, "column string, iqr_outliers bigint, z_outliers bigint, lower double, upper double")
    return table.withColumns({c: F.round(c, 3) for c in ("lower", "upper")})


def box_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numbers behind a box plot: min, whiskers (extremes inside the fences), quartiles, max."""
    stats = {c: s for c, s in column_moments(df, numeric_columns(df, exclude=[target])).items() if s["count"]}
    constants = {c: dict(zip(("low", "high"), fences(s["q1"], s["q3"]), strict=True)) for c, s in stats.items()}
    x = F.col("x")
    found = by_column(
        df, list(stats),
        {"whisker_low": F.min(F.when(x >= F.col("low"), x)), "whisker_high": F.max(F.when(x <= F.col("high"), x))}, constants,
    )
    fields = ["min", "whisker_low", "q1", "median", "q3", "whisker_high", "max"]
    names = list(stats)
    rows = [
        (names[r["cid"]], *[r[f] if f.startswith("whisker") else stats[names[r["cid"]]][f] for f in fields]) for r in found
    ]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["column string", *[f"{f} double" for f in fields]]))
    return table.withColumns({f: F.round(f, 4) for f in fields})


# ---- classes and categories ----------------------------------------------------------------------------------


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``label, n`` per non-missing target value."""
    return nan_to_null(df.select(quoted(target).alias("label"))).filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``label, n, percent`` where the percentage is of all rows."""
    share = percent(F.col("n"), F.lit(df.count()), 2)
    return class_counts(df, target).select("label", "n", share.alias("percent")).orderBy(F.desc("n"), "label")


def top_categories(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_CATEGORIES) -> DataFrame:
    """The ``k`` most frequent values per text column, ties in value order: ``column, value, n, place``."""
    columns = list(columns if columns is not None else text_columns(df))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts_long(df, columns).withColumn("place", place).filter(F.col("place") <= k)


# ---- correlation and histograms ------------------------------------------------------------------------------


def product_sums(rows: DataFrame) -> DataFrame:
    """``i, j, n, x, y, xx, yy, xy`` per pair of columns (by position) over the rows where both are present.

    One pass whatever the width: a task sums the products of its columns as matrices and sends one row per pair.
    """
    width = len(rows.columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            present = ~np.isnan(values)
            values, weight = np.where(present, values, 0.0), present.astype(float)
            total += np.stack([weight.T @ weight, values.T @ weight, (values * values).T @ weight, values.T @ values])
        n, x, xx, xy = total
        i, j = np.indices((width, width)).reshape(2, -1)
        parts = [i, j, n.ravel(), x.ravel(), x.T.ravel(), xx.ravel(), xx.T.ravel(), xy.ravel()]
        yield pa.record_batch([pa.array(p) for p in parts], names)

    names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]
    found = rows.mapInArrow(sums, "i bigint, j bigint, " + ", ".join(f"{c} double" for c in names[2:]))
    return found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])


def correlation_matrix(df: DataFrame, digits: int = 4, states: dict[str, ColumnState] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows where both are present.

    Long form ``a, b, correlation`` with both orders and the diagonal; NULL where a column does not vary. Values are
    centred on their column means first, so that plain sums of products are accurate.
    """
    df = nan_to_null(df)
    columns = numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    if states is None:
        _, _, stats = table_moments(df.select(*[quoted(c) for c in columns]), columns)
    else:
        stats = {c: states[c].moments for c in columns}
    columns = [c for c in columns if stats[c]["count"]]
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    found = product_sums(df.select(*[(number(c) - F.lit(stats[c]["mean"])).alias(f"c{i}") for i, c in enumerate(columns)]))
    varies = F.array(*[F.lit(stats[c]["max"] > stats[c]["min"]) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    vx, vy = (F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("n") for c in ("x", "y"))
    value = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy)
    usable = (F.col("n") > 0) & varies[F.col("i")] & varies[F.col("j")] & (vx > 0) & (vy > 0)
    return found.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.round(F.when(usable, value), digits).alias("correlation"))


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float, float, int]]:
    stats = table_moments(df.select(*[quoted(c) for c in columns]), columns)[2]
    return {c: (s["min"], s["max"], s["mean"], s["std"], s["count"]) for c, s in stats.items() if s["count"]}


def histogram(df: DataFrame, target: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``column, bin, lower, upper, n`` with equal-width bins; a column with one value has one bin.

    Empty bins are not listed.
    """
    df = nan_to_null(df)
    ranges = _ranges(df, numeric_columns(df, exclude=[target]))
    entries = []
    for c, (low, high, *_) in ranges.items():
        width = (high - low) / bins
        x = number(c)
        place = F.least(F.floor((x - low) / F.lit(width)) + 1, F.lit(bins)) if width > 0 else F.lit(1)
        place = F.when(x.isNotNull(), place.cast("int"))
        entries.append(F.struct(F.lit(c).alias("column"), place.alias("bin"), F.lit(low).alias("low"), F.lit(width).alias("width")))
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n bigint")
    counted = (
        df.select(F.inline(F.array(*entries)))
        .filter("bin IS NOT NULL")
        .groupBy("column", "bin", "low", "width")
        .agg(F.count("*").alias("n"))
    )
    lower = F.col("low") + (F.col("bin") - 1) * F.col("width")
    return counted.select(
        "column", "bin", F.round(lower, 4).alias("lower"), F.round(lower + F.col("width"), 4).alias("upper"), "n"
    )


def histogram_normal(df: DataFrame, target: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Normal density (mean and sample std of the column) at the centre of each histogram bin."""
    df = nan_to_null(df)
    rows = [
        (c, low + 0.0, (high - low) / bins, mean, std)
        for c, (low, high, mean, std, n) in _ranges(df, numeric_columns(df, exclude=[target])).items()
        if n > 1 and std and std > 0
    ]
    fitted = df.sparkSession.createDataFrame(rows, "column string, low double, width double, mean double, std double")
    centre = F.col("low") + (F.col("bin") - 0.5) * F.col("width")
    z = (centre - F.col("mean")) / F.col("std")
    return fitted.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).select(
        "column",
        "bin",
        F.round(centre, 4).alias("centre"),
        F.round(F.exp(-0.5 * z * z) / (F.col("std") * F.sqrt(2 * F.pi())), 8).alias("density"),
    )


# ---- rows ----------------------------------------------------------------------------------------------------


def split_summary(df: DataFrame, test_size: float) -> DataFrame:
    """Row counts and percentages of a train/test split of the given size."""
    train = F.floor(F.count("*") * F.lit(1 - test_size)).cast("bigint")
    counted = df.agg(F.count("*").alias("total"), train.alias("train"))
    test = F.col("total") - F.col("train")
    return counted.select(
        "total",
        "train",
        test.alias("test"),
        percent(F.col("train"), F.col("total"), 2).alias("train_percent"),
        percent(test, F.col("total"), 2).alias("test_percent"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, as a count and percentage of all rows."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    keys = [typed_key(c, fields[c], digest=True) for c in df.columns]
    rows = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    grouped = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    repeats = F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint"))
    return grouped.agg(
        total.alias("n_rows"), repeats.alias("duplicates"), percent(repeats, total, 2).alias("duplicate_percent")
    )


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def column_types(df: DataFrame) -> DataFrame:
    """``position, column, dtype``."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def profile_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """The whole profile as one long table ``section, name, metric, value``.

    Shape, missing values and moments come from the column states, which are gathered once.
    """
    df = nan_to_null(df)
    states = column_states(df)

    def melt(table: DataFrame, section: str, name: Column, metrics: Sequence[str]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return table.select(F.lit(section).alias("section"), name.alias("name"), F.inline(F.array(*cells)))

    parts = [
        melt(basic_stats(df, states), "overview", F.lit("table"), ["n_rows", "n_columns", "n_numeric", "n_categorical", "missing_percent"]),
        melt(summary_stats(df, states=states), "variables", F.col("column"), ["count", "mean", "std", "min", "q1", "median", "q3", "max"]),
        melt(missing_by_column(df, states), "missing", F.col("column"), ["missing", "percent"]),
        melt(correlation_matrix(df, states=states), "correlations", F.concat_ws("~", "a", "b"), ["correlation"]),
        melt(duplicate_rows(df), "duplicates", F.lit("table"), ["duplicates", "duplicate_percent"]),
        melt(top_categories(df, columns_of_kind(df, "text")), "categories", F.concat_ws("=", "column", "value"), ["n"]),
    ]
    if target is not None:
        parts.append(melt(class_distribution(df, target), "classes", F.col("label").cast("string"), ["n", "percent"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
