"""Class rebalancing: undersampling, oversampling, balanced class weights.

Only the smallest and the largest class take part in resampling; classes between them are left out. Ties go to the
smallest label, and if both counts are equal the table is returned as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.functions.lookup import lookup
from tabwright.functions.ordering import replicate, running_sum, shuffle_key
from tabwright.operators.profile import class_counts
from tabwright.operators.repair import STAGE_IMBALANCE, log_entry
from tabwright.operators.split import first_rows
from tabwright.session import cut_lineage

POSITIONS_PER_TASK = 1_000_000
MOST_POSITION_BUCKETS = 100_000


@dataclass
class ClassSizes:
    minority: object
    majority: object
    low: int
    high: int


def class_sizes(df: DataFrame, target: str) -> ClassSizes | None:
    counts = class_counts(df, target)
    small = counts.orderBy("n", "label").first()
    large = counts.orderBy(F.desc("n"), "label").first()
    if small is None or small["n"] == large["n"]:
        return None
    return ClassSizes(small["label"], large["label"], small["n"], large["n"])


def undersample(df: DataFrame, target: str, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """All rows of the smallest class and equally many of the largest."""
    sizes = class_sizes(df, target)
    if sizes is None:
        return df
    minority = df.filter(quoted(target) == F.lit(sizes.minority))
    majority = df.filter(quoted(target) == F.lit(sizes.majority))
    quota = df.sparkSession.createDataFrame([(1, 0, sizes.low)], "_group int, part int, quota bigint")
    kept = first_rows(majority, F.lit(1), quota, keys, seed).filter("part = 0").drop("part")
    return minority.unionByName(kept)


def oversample(df: DataFrame, target: str, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """The smallest and the largest class, with draws (with replacement) that make the smallest as large."""
    sizes = class_sizes(df, target)
    if sizes is None:
        return df
    minority = df.filter(quoted(target) == F.lit(sizes.minority))
    majority = df.filter(quoted(target) == F.lit(sizes.majority))
    drawn = draw_rows(minority, sizes.low, sizes.high - sizes.low, seed, keys)
    return majority.unionByName(minority).unionByName(drawn)


def draw_rows(df: DataFrame, n_rows: int, draws: int, seed: int, keys: Sequence[str] | None = None) -> DataFrame:
    """``draws`` rows of ``df`` (``n_rows`` rows) with replacement.

    Rows lie on positions 0..n_rows-1 in md5 order, equal rows as one stretch of positions. Draw ``i`` hits position
    ``hash(seed, i) mod n_rows``; which row lies there is the last stretch that starts at or before it, found by one
    pass over position buckets of even size.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, keys, df))
    if keys:
        stretches = keyed.withColumn("_n", F.lit(1).cast("bigint"))
    else:
        firsts = [F.first(quoted(c)).alias(c) for c in df.columns]
        stretches = keyed.groupBy("_key").agg(F.count("*").alias("_n"), *firsts)
    placed = running_sum(stretches, [F.col("_key")], {"_end": F.col("_n")})
    width = max(POSITIONS_PER_TASK, -(-n_rows // MOST_POSITION_BUCKETS))
    start = F.col("_end") - F.col("_n")
    buckets = F.sequence(F.floor(start / F.lit(width)), F.floor((F.col("_end") - 1) / F.lit(width)))
    starts = placed.withColumn("_start", start).withColumn("_bucket", F.explode(buckets))
    starts = starts.select(
        "_bucket",
        F.greatest("_start", F.col("_bucket") * F.lit(width)).alias("_at"),
        F.lit(0).cast("bigint").alias("_hits"),
        F.struct(*[quoted(c) for c in df.columns]).alias("_row"),
    )
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("id").cast("string"))), 1, 15), 16, 10)
    hits = df.sparkSession.range(draws).select((code.cast("bigint") % F.lit(n_rows)).alias("_at"))
    hits = hits.groupBy("_at").agg(F.count("*").alias("_hits"))
    hits = hits.select(
        F.floor(F.col("_at") / F.lit(width)).alias("_bucket"), "_at", "_hits",
        F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"),
    )
    order = Window.partitionBy("_bucket").orderBy("_at", "_hits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = starts.unionByName(hits).withColumn("_row", F.last("_row", ignorenulls=True).over(order)).filter("_hits > 0")
    return replicate(matched.select("_row.*", "_hits"), "_hits")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight = rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    row = counts.agg(F.sum("n"), F.count("*")).first()
    return counts.withColumn("weight", F.try_divide(F.lit(float(row[0] or 0)), F.lit(row[1]) * F.col("n")))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Rows with the weight of their class."""
    table = cut_lineage(class_weights(df, label)).select(F.col("label").alias(label), F.col("weight").alias(name), F.col("n").alias("_n"))
    return lookup(df, table, [label], "_n")


def balance(
    df: DataFrame, target: str, action: str, seed: int = 42, keys: Sequence[str] | None = None
) -> tuple[DataFrame, list[dict]]:
    """Apply one of class_weights, undersampling, oversampling, no action. Weights are only noted for the fit."""
    before = class_counts(df, target)
    if action not in ("undersampling", "oversampling"):
        return df, [log_entry(STAGE_IMBALANCE, target, detail_action=action)]
    sizes = class_sizes(df, target)
    total = before.agg(F.sum("n")).first()[0] or 0
    if sizes is None:
        return df, [log_entry(STAGE_IMBALANCE, target, detail_action=action, rows_removed=0, rows_remaining=total)]
    rows_after = 2 * (sizes.low if action == "undersampling" else sizes.high)
    out = (undersample if action == "undersampling" else oversample)(df, target, seed, keys)
    return out, [
        log_entry(STAGE_IMBALANCE, target, detail_action=action, rows_removed=total - rows_after, rows_remaining=rows_after)
    ]
