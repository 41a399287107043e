"""Gaussian naive Bayes in closed form over plain columns: a table with one row of parameters per class.

Neither the classes nor the features of a class ever become expressions of a plan or lists on the driver: features are
stacked to fit, and rows are scored against arrays of parameters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import number, quoted
from tabwright.functions.lookup import BROADCAST_BYTES, table_bytes
from tabwright.session import cut_lineage

# Share of the largest feature variance that is added to every variance.
SMOOTHING = 1e-9


def fit_gaussian(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``label, n, prior, means, variances`` per class, arrays in the order of ``features``. Rows without a label don't count."""
    rows = df.filter(quoted(label).isNotNull()).select(quoted(label).cast("double").alias("label"), F.array(*[number(c) for c in features]).alias("x"))
    long = rows.select("label", F.posexplode("x").alias("place", "x"))
    # Moments per class and feature; those of a feature over all classes follow from them.
    each = cut_lineage(long.groupBy("label", "place").agg(F.count("*").alias("n"), F.count("x").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")))
    weight = F.sum("k")
    mean = F.sum(F.col("k") * F.col("mean")) / weight
    centred = each.join(F.broadcast(each.groupBy("place").agg(mean.alias("all"))), "place")
    gap = F.col("mean") - F.col("all")
    spread = F.sum(F.col("k") * (F.col("var") + gap * gap)) / weight
    extra = F.lit(SMOOTHING * (centred.groupBy("place").agg(spread.alias("var")).agg(F.max("var")).first()[0] or 0.0))
    entry = F.struct("place", "mean", (F.col("var") + extra).alias("var"))
    classes = each.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))
    total = rows.count()
    return cut_lineage(classes.select(
        "label", "n", (F.col("n") / F.lit(float(total))).alias("prior"), F.col("entries.mean").alias("means"), F.col("entries.var").alias("variances")
    ))


def params_frame(features: Sequence[str], fitted: DataFrame) -> DataFrame:
    """``label, feature, prior, mean, variance``."""
    long = fitted.select("label", "prior", F.posexplode(F.arrays_zip("means", "variances")).alias("place", "p"))
    names = F.array(*[F.lit(c) for c in features])
    return long.select("label", names[F.col("place")].alias("feature"), "prior", F.col("p.means").alias("mean"), F.col("p.variances").alias("variance"))


def likelihood(x: Column, of: Column) -> Column:
    """Joint log-likelihood of the values ``x`` and a class."""

    def term(value: Column, p: Column) -> Column:
        gap = value - p["means"]
        return 0.5 * F.log(2 * math.pi * p["variances"]) + gap * gap / (2 * p["variances"])

    terms = F.zip_with(x, F.arrays_zip(of["means"], of["variances"]), term)
    return F.log(of["prior"]) - F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def predict_gaussian(
    df: DataFrame, features: Sequence[str], fitted: DataFrame, name: str = "prediction", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The label with the largest joint log-likelihood; the smallest label on ties.

    The classes are broadcast in as many groups as their measured size asks for, and each group improves the best so far.
    """
    groups = max(1, -(-table_bytes(fitted) // broadcast_bytes))
    keyed = fitted.withColumn("_group", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))
    best: Column = F.lit(None).cast("struct<score: double, minus: double>")
    out = df.withColumn("_best", best)
    x = F.array(*[number(c) for c in features])
    for group in range(groups):
        part = keyed.filter(F.col("_group") == group)
        classes = part.groupBy("_group").agg(F.collect_list(F.struct("label", "prior", "means", "variances")).alias("_classes"))
        joined = out.withColumn("_group", F.lit(group)).join(F.broadcast(classes), "_group", "left")
        scores = F.transform("_classes", lambda of: F.struct(likelihood(x, of).alias("score"), (-of["label"]).alias("minus")))
        out = joined.withColumn("_best", F.greatest("_best", F.array_max(scores))).drop("_group", "_classes")
    return out.withColumn(name, -F.col("_best.minus")).drop("_best")
