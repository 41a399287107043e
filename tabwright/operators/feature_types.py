"""A semantic type per column, by a cascade of rules over the column profile; the first rule that fits wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import grouping_key, kind_of, nan_to_null, quoted, text_columns
from tabwright.operators.profile import add_quartiles, distinct_stats
from tabwright.operators.states import ColumnState, column_states
from tabwright.session import spread_small

# The semantic types and the thresholds of the rules.
CONTINUOUS = "continuous_numeric"
DISCRETE = "discrete_numeric"
BINARY = "binary"
ENCODED = "categorical_encoded"
TEXT = "categorical_text"
ID_LIKE = "id_like"
DATETIME = "datetime"
UNKNOWN = "unknown"
ID_RATIO = 0.95
ENCODED_INT_VALUES = 10
CONTINUOUS_INT_VALUES = 20
CONTINUOUS_INT_RANGE = 50
ENCODED_FLOAT_VALUES = 15
DATETIME_RATIO = 0.9
# A value that holds all rows but this share makes a column near-constant.
RARE_SHARE = 0.01

NUMERIC_TYPES = (CONTINUOUS, DISCRETE)
CATEGORICAL_TYPES = (TEXT, ENCODED, BINARY)

TYPES_SCHEMA = (
    "column string, type string, n_rows bigint, n_unique bigint, n_missing bigint, unique_ratio double, min double, "
    "max double, range double, mean double, median double, std double, q1 double, q3 double, examples array<string>, "
    "note string"
)


@dataclass
class ColumnType:
    """What is known about one column.

    ``n_unique`` may be an estimate (``counted`` is False) where nothing depends on the exact number: the type is the
    same for all numbers it may be, none of it is reported, and no value can hold nearly all rows. The count of the most
    frequent value is 0 then. ``top_hash`` finds that value where all values were counted in the first pass.
    """

    column: str
    type: str
    n_rows: int
    n_unique: int
    n_missing: int
    top_count: int = 0
    moments: dict = field(default_factory=dict)
    examples: list[str] = field(default_factory=list)
    note: str | None = None
    counted: bool = True
    top_hash: int | None = None

    @property
    def unique_ratio(self) -> float:
        return self.n_unique / self.n_rows if self.n_rows else 0.0


FeatureTypes = dict[str, ColumnType]


def classify(kind: str, n_rows: int, n_unique: int, n_missing: int, low=None, high=None, date_share: float = 0.0):
    """``(type, note)`` of a column from its kind and counts.

    A column of whole numbers with gaps is judged as a float column, and a boolean column with gaps as text, since
    that is what those columns are in a table whose only missing value is NaN.
    """
    ratio = n_unique / n_rows if n_rows else 0.0
    if n_missing and kind == "int":
        kind = "float"
    elif n_missing and kind == "bool":
        kind = "text"
    if n_unique == 0 and n_missing and kind != "text":
        return ENCODED, "no values"
    if kind == "bool":
        return BINARY, "boolean"
    if kind == "text":
        if date_share >= DATETIME_RATIO:
            return DATETIME, "parses as a timestamp"
        return (ID_LIKE, "almost all values differ") if ratio >= ID_RATIO else (TEXT, None)
    if n_unique == 2:
        return BINARY, "two values"
    if kind == "int":
        if ratio >= ID_RATIO:
            return ID_LIKE, "almost all values differ"
        if n_unique <= ENCODED_INT_VALUES:
            return ENCODED, "few whole numbers"
        wide = n_unique > CONTINUOUS_INT_VALUES or high - low > CONTINUOUS_INT_RANGE
        return (CONTINUOUS if wide else DISCRETE), None
    if kind == "float":
        return (ENCODED, "few numbers") if n_unique <= ENCODED_FLOAT_VALUES else (CONTINUOUS, None)
    return UNKNOWN, None


def timestamp_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, values, parsed, ratio``: share of the non-missing texts that read as a timestamp."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(quoted(c)).alias("values"),
            F.count(F.try_to_timestamp(quoted(c).cast("string"))).alias("parsed"),
        )
        for c in columns
    ]
    ratio = F.coalesce(F.try_divide(F.col("parsed"), F.col("values")), F.lit(0.0))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).withColumn("ratio", F.round(ratio, 4))


def open_question(kind: str, state: ColumnState, date_share: float) -> bool:
    """Whether the number of different values has to be counted: the estimate allows several types, the type is one whose
    number is reported, or so few values differ that one may hold nearly all rows."""
    fewest, most = state.bounds()
    low, high = state.moments["min"], state.moments["max"]
    found = {classify(kind, state.n, n, state.missing, low, high, date_share)[0] for n in (fewest, most)}
    return len(found) > 1 or not found.isdisjoint((TEXT, ENCODED)) or (fewest - 1) <= RARE_SHARE * state.present


def infer_types(
    df: DataFrame, target: str | None = None, detect_datetime: bool = False, examples: bool = False, exact: bool = False,
    states: dict[str, ColumnState] | None = None,
) -> FeatureTypes:
    """Type of every column but the target. Timestamps in text are looked for only on request.

    One pass gives the states of all columns (``states``, if they are known already). Only columns with more different
    values than a state counts are counted again, and of these, unless ``exact`` asks for all, only those where it matters.
    """
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != target]
    kind = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    texts = text_columns(df, exclude=[target])
    states = column_states(df, columns, texts if examples else ()) if states is None else states
    shares = {}
    if detect_datetime and texts:
        shares = {r["column"]: r["parsed"] / r["values"] if r["values"] else 0.0 for r in timestamp_shares(df, texts).collect()}
    again = [c for c in columns if not states[c].exact and (exact or open_question(kind[c], states[c], shares.get(c, 0.0)))]
    n_rows = states[columns[0]].n if columns else 0
    # Long texts go by their digests before rows are spread: these are counted as the texts are, and little to move.
    keys = [(grouping_key(quoted(c)) if c in texts else quoted(c)).alias(c) for c in again]
    distinct = distinct_stats(spread_small(df.select(*keys), n_rows), again) if again else {}
    out: FeatureTypes = {}
    for c in columns:
        s = states[c]
        n_unique, top = distinct.get(c, (s.n_values, s.top_count or 0))
        name, note = classify(kind[c], n_rows, n_unique, s.missing, s.moments["min"], s.moments["max"], shares.get(c, 0.0))
        moments = dict(s.moments) if name in NUMERIC_TYPES else {}
        out[c] = ColumnType(c, name, n_rows, n_unique, s.missing, top, moments, s.smallest, note, s.exact or c in distinct, s.top_hash)
    add_quartiles(df, {c: t.moments for c, t in out.items()}, of_type(out, *NUMERIC_TYPES), n_rows)
    return out


def types_frame(spark: SparkSession, types: FeatureTypes) -> DataFrame:
    """The types as a table, one row per column. Types inferred with ``exact`` have counts, others may have estimates."""
    rows = []
    for t in types.values():
        m = t.moments
        spread = m["max"] - m["min"] if m else None
        rows.append(
            (t.column, t.type, t.n_rows, t.n_unique, t.n_missing, t.unique_ratio)
            + tuple(m.get(k) if k != "range" else spread for k in ("min", "max", "range", "mean", "median", "std", "q1", "q3"))
            + (t.examples, t.note)
        )
    return spark.createDataFrame(rows, TYPES_SCHEMA).withColumn("unique_ratio", F.round("unique_ratio", 4))


def feature_types(df: DataFrame, target: str | None = None, detect_datetime: bool = False) -> DataFrame:
    return types_frame(df.sparkSession, infer_types(df, target, detect_datetime, examples=True, exact=True))


def of_type(types: FeatureTypes, *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t.type in wanted]


def column_groups(types: FeatureTypes) -> dict[str, list[str]]:
    """How columns enter a model: numeric block, categorical block, dropped by type, or left out silently."""
    return {
        "numeric": of_type(types, *NUMERIC_TYPES),
        "categorical": of_type(types, *CATEGORICAL_TYPES),
        "dropped_datetime": of_type(types, DATETIME),
        "dropped_id_like": of_type(types, ID_LIKE),
        "left_out": of_type(types, UNKNOWN),
    }


def column_groups_frame(spark: SparkSession, types: FeatureTypes) -> DataFrame:
    rows = [(c, group) for group, columns in column_groups(types).items() for c in columns]
    return spark.createDataFrame(rows, "column string, group string")


def type_summary(types_table: DataFrame) -> DataFrame:
    """``type, n_columns, columns`` from a types table; columns in name order."""
    return types_table.groupBy("type").agg(
        F.count("*").alias("n_columns"), F.concat_ws(",", F.array_sort(F.collect_list("column"))).alias("columns")
    )


def drop_unusable(df: DataFrame, types: FeatureTypes) -> DataFrame:
    """Without datetime and id-like columns, which would only blow up or leak into a model."""
    return df.drop(*of_type(types, DATETIME, ID_LIKE))
