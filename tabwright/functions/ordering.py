"""Global order on a cluster: running totals, dense numbering, first-n-per-group and copies of rows.

A window without a partition key, or with one hot key, sorts everything in one task. These helpers use such a
window only for a checked number of rows. Otherwise they range-sort once, keep that order in a checkpoint, and
add per-partition offsets; or they find a cut-off key by counting prefixes, which moves no rows at all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import measured_text, quoted
from tabwright.functions.lookup import fits_broadcast
from tabwright.session import cut_lineage

SINGLE_TASK_ROWS = 1_000_000
COPIES_PER_TASK_ROW = 100_000
PREFIX_LENGTHS = (4, 10)  # hex digits, at least and at most
PREFIX_ROWS = 10_000  # rows of one prefix, about


def running_sum(
    df: DataFrame, order: Sequence[Column], sums: dict[str, Column], single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Add one running total (current row included) per entry of ``sums``. ``order`` must be total.

    ``df`` is usually a grouped table over a large scan: it is written once and counted from there.
    """
    df = cut_lineage(df)
    if at_most(df, single_task_rows):
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    named = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    parts = _sorted_partitions(named, order)
    totals = parts.groupBy("_part").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so this side is bounded by the partition count.
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(offsets), "_part")
    out = out.withColumns({name: F.sum(f"_v_{name}").over(within) + F.col(f"_o_{name}") for name in sums})
    return out.select(*df.columns, *sums)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def _sorted_partitions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in global order with their partition and place, fixed in a checkpoint."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_place", 33))


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the given total order."""
    numbered = running_sum(df, order, {name: F.lit(1).cast("bigint")}, single_task_rows)
    return numbered.withColumn(name, F.col(name) - 1)


def shuffle_key(seed: int, keys: Sequence[str] | None, df: DataFrame) -> Column:
    """A repeatable random order: md5 of seed and key columns, or of the whole row when no key is given.

    Rows have one key exactly when they are equal: values count in full, and several of them are told apart by length.
    """
    if keys and len(keys) == 1:
        parts = [F.coalesce(quoted(keys[0]).cast("string"), F.lit("\\N"))]
    else:
        types = {f.name: f.dataType for f in df.schema.fields}
        parts = [F.concat(*[measured_text(quoted(c), types[c]) for c in keys or df.columns])]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def cut_keys(keyed: DataFrame, group: str, quotas: DataFrame) -> DataFrame:
    """Per (group, part): the key at which the first ``quota`` rows of the group end.

    ``keyed`` has ``group`` and ``_key`` (hex text); ``quotas`` has ``group``, ``part``, ``quota`` (>= 1). Result:
    ``group, part, cut, taken, copies``: ``taken`` of the ``copies`` rows with that key are among the first.
    Two counting passes; the second looks only at one prefix bucket per (group, part).
    """
    digits = math.ceil(math.log(max(1, keyed.count() / PREFIX_ROWS), 16))
    prefix = F.substring("_key", 1, min(max(PREFIX_LENGTHS[0], digits), PREFIX_LENGTHS[1]))
    coarse = keyed.groupBy(group, prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    by_prefix = Window.partitionBy(group).orderBy("_prefix")
    coarse = coarse.withColumn("_upto", F.sum("_n").over(by_prefix))
    hit = (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota"))
    buckets = (
        coarse.join(quotas, group)
        .filter(hit)
        .select(group, "part", "_prefix", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    # One row per group and part: kept, measured, and broadcast if small, so that ``keyed`` is not shuffled for it.
    buckets = cut_lineage(buckets)
    if fits_broadcast(buckets):
        buckets = F.broadcast(buckets)
    fine = (
        keyed.select(group, "_key", prefix.alias("_prefix"))
        .join(buckets, [group, "_prefix"])
        .groupBy(group, "part", "_left", "_key")
        .agg(F.count("*").alias("copies"))
    )
    by_key = Window.partitionBy(group, "part").orderBy("_key")
    fine = fine.withColumn("_upto", F.sum("copies").over(by_key))
    start = F.col("_upto") - F.col("copies")
    return fine.filter((F.col("_upto") >= F.col("_left")) & (start < F.col("_left"))).select(
        group, "part", F.col("_key").alias("cut"), (F.col("_left") - start).alias("taken"), "copies"
    )


def replicate(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times (the column is dropped); a large count is spread over many tasks."""
    step = F.lit(COPIES_PER_TASK_ROW)
    chunks = F.when(F.col(times) > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / step)))
    chunked = df.withColumn("_chunk", F.explode(chunks))
    if df.filter(F.col(times) > step).limit(1).count():
        chunked = chunked.withColumn("_row_key", shuffle_key(0, None, df)).repartition("_row_key", "_chunk").drop("_row_key")
    copies = F.least(step.cast("bigint"), F.col(times) - F.col("_chunk") * step)
    return chunked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop(
        "_chunk", "_copy", times
    )
