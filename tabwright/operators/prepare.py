"""Feature preparation fitted on a training table: imputers, scalers, category encoders, vector assembly.

Column-level numbers (fills, means, scales) live on the driver; category tables stay distributed and are joined on. The
prepared form of a table is its numeric columns scaled, its categorical columns as codes, and a sparse vector of both,
made of pairs of slot and value. The scale of a category comes with its code.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import kind_of, kinds, nan_to_null, number, quoted, typed_key
from tabwright.functions.lookup import lookup
from tabwright.functions.ordering import number_rows
from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators.profile import modes, table_moments, value_counts
from tabwright.session import cut_lineage

# Names of the strategies.
STANDARD, MINMAX = "StandardScaler", "MinMaxScaler"
ONEHOT, ORDINAL = "OneHotEncoder", "OrdinalEncoder"
UNKNOWN_CODE = -1
OTHER_CATEGORY = "Other"

WIDEST_VECTOR = 2_000_000


@dataclass
class NumericFit:
    column: str
    fill: float
    centre: float
    scale: float

    def filled(self) -> Column:
        return F.coalesce(number(self.column), F.lit(float(self.fill)))

    def scaled(self) -> Column:
        return (self.filled() - F.lit(float(self.centre))) / F.lit(float(self.scale))


@dataclass
class FittedPrep:
    """What was learnt from the training table."""

    numeric: list[NumericFit]
    categorical: dict[str, object]  # column -> fill value
    encoding: str
    scaling: str
    n_rows: int
    categories: DataFrame | None = None  # column, value, n, code, std
    sizes: dict[str, int] = field(default_factory=dict)
    others: dict[str, list] = field(default_factory=dict)  # grouped column -> code and scale of the category for rare values

    def save(self, path: str) -> None:
        spark = self.categories.sparkSession if self.categories is not None else SparkSession.active()
        state = dict(
            numeric=[asdict(n) for n in self.numeric], categorical=self.categorical, encoding=self.encoding,
            scaling=self.scaling, n_rows=self.n_rows, sizes=self.sizes, others=self.others,
        )
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        if self.categories is not None:
            self.categories.write.mode("overwrite").parquet(f"{path}/categories")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPrep:
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        state["numeric"] = [NumericFit(**n) for n in state["numeric"]]
        table = spark.read.parquet(f"{path}/categories") if state["categorical"] else None
        return FittedPrep(**state, categories=table)


def fit_fills(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], strategy: str = "median") -> tuple[dict, dict]:
    """Fill values: mean, median or most frequent number (median for anything else), most frequent category."""
    df = nan_to_null(df)
    if strategy == "mean":
        fills = {c: s["mean"] for c, s in table_moments(df.select(*[quoted(c) for c in numeric]), numeric)[2].items()} if numeric else {}
    elif strategy == "most_frequent":
        fills = modes(df, numeric)
    else:
        fills = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    top = modes(df, categorical)
    return {c: float(v) for c, v in fills.items() if v is not None}, top


def as_text(name: str) -> Column:
    return quoted(name).cast("string")


def fit(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    strategy: str = "median",
    scaling: str = STANDARD,
    encoding: str = ONEHOT,
    grouped: Sequence[str] = (),
) -> FittedPrep:
    """Learn fills, scales and category codes from ``train``.

    In ``grouped`` columns rare values have become one category; values that training lacks belong to it, too.
    """
    train = nan_to_null(train)
    numeric, categorical = list(numeric), list(categorical)
    fills, top = fit_fills(train, numeric, categorical, strategy)
    # A column without any value has nothing to fill with or to learn from.
    numeric, categorical = [c for c in numeric if c in fills], [c for c in categorical if top[c] is not None]
    top = {c: top[c] for c in categorical}
    filled = train.select(
        *[F.coalesce(number(c), F.lit(fills[c])).alias(c) for c in numeric],
        *[fill_category(c, top[c]).alias(c) for c in categorical],
    )
    n_rows, _, stats = table_moments(filled, numeric)
    fits = []
    for c in numeric:
        s = stats[c]
        centre, scale = (s["mean"], s["std_pop"]) if scaling == STANDARD else (s["min"], (s["max"] or 0) - (s["min"] or 0))
        flat = s["max"] == s["min"]  # a constant column scales to 0 and must not divide by rounding noise
        fits.append(NumericFit(c, fills[c], centre or 0.0, 1.0 if flat or not scale else scale))
    prep = FittedPrep(fits, top, encoding, scaling, n_rows)
    if categorical:
        prep.categories = cut_lineage(category_table(filled, categorical, n_rows))
        prep.sizes = {r["column"]: r["n"] for r in prep.categories.groupBy("column").agg(F.count("*").alias("n")).collect()}
        rare = prep.categories.filter(F.col("column").isin(list(grouped)) & (F.col("value") == OTHER_CATEGORY))
        prep.others = {r["column"]: [r["code"], r["scale"]] for r in rare.select("column", "code", scale_of().alias("scale")).collect()}
    return prep


def fill_category(column: str, value: object) -> Column:
    return quoted(column) if value is None else F.coalesce(quoted(column), F.lit(value))


def category_table(filled: DataFrame, categorical: Sequence[str], n_rows: int) -> DataFrame:
    """``column, value, n, code, std``: categories in sorted order, numbers in number order; ``std`` of the indicator."""
    counted = value_counts(filled, categorical)
    exact = [i for i, c in enumerate(categorical) if isinstance(filled.schema[c].dataType, T.DecimalType)]
    in_order = F.when(F.col("cid").isin(exact), F.col("as_text").cast("double"))
    ordered = number_rows(counted, [F.col("cid"), F.col("as_long"), F.coalesce("as_double", in_order), F.col("as_text")], "place")
    starts = ordered.groupBy("cid").agg(F.min("place").alias("start"))  # one row per column
    names = F.array(*[F.lit(c) for c in categorical])
    share = F.col("n") / F.lit(float(n_rows))
    value = F.coalesce(F.col("as_long").cast("string"), F.col("as_double").cast("string"), F.col("as_text"))
    return ordered.join(F.broadcast(starts), "cid").select(
        names[F.col("cid")].alias("column"),
        value.alias("value"),
        "n",
        (F.col("place") - F.col("start")).cast("int").alias("code"),
        F.sqrt(share * (1 - share)).alias("std"),
    )


def scale_of() -> Column:
    """What a one-hot entry of a category is multiplied with: one over the deviation of its indicator, if it varies."""
    return F.when(F.col("std") > 0, 1 / F.col("std")).otherwise(F.lit(1.0))


def with_codes(prep: FittedPrep, df: DataFrame, columns: Sequence[str] | None = None, scales: bool = False) -> DataFrame:
    """Add ``code_<column>`` per categorical column; -1 for a category not seen in training. With ``scales`` also
    ``scale_<column>``."""
    for c in columns if columns is not None else prep.categorical:
        table = prep.categories.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"), scale_of().alias("_scale"), "n"
        )
        keyed = df.withColumn("_value", fill_category(c, prep.categorical[c]).cast("string"))
        coded = lookup(keyed, table if scales else table.drop("_scale"), ["_value"], "n")
        code, scale = prep.others.get(c, (UNKNOWN_CODE, 1.0))
        df = coded.withColumn(f"code_{c}", F.coalesce("_code", F.lit(code)))
        if scales:
            df = df.withColumn(f"scale_{c}", F.coalesce("_scale", F.lit(float(scale)))).drop("_scale")
        df = df.drop("_value", "_code")
    return df


def scaled_columns(prep: FittedPrep, df: DataFrame, prefix: str = "scaled_") -> DataFrame:
    return df.withColumns({prefix + n.column: n.scaled() for n in prep.numeric}) if prep.numeric else df


def onehot_long(prep: FittedPrep, df: DataFrame, keys: Sequence[str], scaled: bool = False) -> DataFrame:
    """Non-zero one-hot entries as ``keys, feature, value`` (``feature`` is ``column=category``)."""
    parts = None
    for c, fill in prep.categorical.items():
        table = prep.categories.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), "n", scale_of().alias("_scaled")
        )
        keyed = df.select(*keys, fill_category(c, fill).cast("string").alias("_value"))
        hit = lookup(keyed, table, ["_value"], "n").filter("_scaled IS NOT NULL")
        value = F.col("_scaled") if scaled else F.lit(1.0)
        part = hit.select(*keys, F.concat(F.lit(f"{c}="), "_value").alias("feature"), value.alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def starts(prep: FittedPrep) -> dict[str, int]:
    """The first slot of each categorical column's one-hot block."""
    out, at = {}, len(prep.numeric)
    for c in prep.categorical:
        out[c] = at
        at += prep.sizes.get(c, 0)
    return out


def feature_table(spark: SparkSession, prep: FittedPrep) -> DataFrame:
    """``slot, feature``: the names of the vector's slots (``column=category`` in one-hot blocks)."""
    plain = [n.column for n in prep.numeric] + (list(prep.categorical) if prep.encoding == ORDINAL else [])
    table = spark.createDataFrame(list(enumerate(plain)), "slot int, feature string")
    if prep.encoding == ORDINAL or prep.categories is None:
        return table
    begins = F.broadcast(spark.createDataFrame(list(starts(prep).items()), "column string, start int"))  # a row per column
    hot = prep.categories.join(begins, "column")
    return table.union(hot.select(F.col("start") + F.col("code"), F.concat("column", F.lit("="), "value")))


def feature_names(prep: FittedPrep) -> list[str]:
    """Names of the vector's slots, in order, for vectors of the checked width."""
    check_width(prep)
    return [r["feature"] for r in feature_table(SparkSession.active(), prep).orderBy("slot").collect()]


def check_width(prep: FittedPrep) -> int:
    """Slots of the assembled vector. A model holds a number per slot on the driver, so the width is checked."""
    width = len(prep.numeric) + (sum(prep.sizes.values()) if prep.encoding == ONEHOT else len(prep.categorical))
    if width > WIDEST_VECTOR:
        widest = max(prep.sizes, key=prep.sizes.get)
        raise ValueError(f"one-hot vector of {width} slots ({widest} has most); group rare categories or encode ordinal")
    return width


def as_vector(size: int, slots: Column, values: Column) -> Column:
    """A sparse vector of slots (ascending) and values. SQL has no cast to vectors, so the parts cross Arrow as they are."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), slots.alias("indices"), values.alias("values"))
    return F.arrow_udf(lambda vectors: vectors, VectorUDT())(parts)


def assemble(prep: FittedPrep, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` (numeric block, then categorical block) next to the columns in ``keep``.

    With one-hot blocks, a row has its numbers and one entry per categorical column; none for an unknown category.
    """
    width, onehot = check_width(prep), prep.encoding == ONEHOT
    df = scaled_columns(prep, with_codes(prep, nan_to_null(df), scales=onehot))
    if not onehot:
        inputs = [f"scaled_{n.column}" for n in prep.numeric] + [f"code_{c}" for c in prep.categorical]
        out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(df)
        return out.select(*[quoted(c) for c in keep], "features")
    slots: list[Column] = [F.lit(i) for i in range(len(prep.numeric))]
    values: list[Column] = [quoted(f"scaled_{n.column}") for n in prep.numeric]
    for c, start in starts(prep).items():
        known = quoted(f"code_{c}") >= 0
        slots.append(F.when(known, F.lit(start) + quoted(f"code_{c}")))
        values.append(F.when(known, quoted(f"scale_{c}")))
    features = as_vector(width, F.array_compact(F.array(*slots)), F.array_compact(F.array(*values)))
    return df.select(*[quoted(c) for c in keep], features.alias("features"))


# ---- target --------------------------------------------------------------------------------------------------


def target_codes(train: DataFrame, target: str) -> DataFrame:
    """``column, value, n, code``: sorted labels of the training table as 0..k-1."""
    labelled = train.filter(quoted(target).isNotNull())
    return cut_lineage(category_table(labelled.select(quoted(target)), [target], labelled.count()).drop("std"))


def encode_target(df: DataFrame, target: str, codes: DataFrame, name: str = "label") -> DataFrame:
    table = codes.select(F.col("value").alias("_value"), F.col("code").cast("double").alias(name), "n")
    text = typed_key(target, df.schema[target].dataType, digest=False).cast("string")
    return lookup(df.withColumn("_value", text), table, ["_value"], "n").drop("_value")


def is_text(df: DataFrame, column: str) -> bool:
    return kind_of(df.schema[column].dataType) in ("text", "other")


def integer_target(column: str) -> Column:
    """A numeric target as a whole number, fractions cut off."""
    return quoted(column).cast("int")
