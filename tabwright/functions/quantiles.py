"""Exact quantiles (linear interpolation) without gathering a large column in one task.

Up to a checked number of rows, the distinct values of each column are counted and ordered per column. Beyond that, a
bounded-error sketch brackets each wanted rank, grid rounds narrow the brackets while they hold too many rows, and only
the few values left are counted exactly. Each round is one aggregation that returns a single row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import number
from tabwright.session import spread_small

DIRECT_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
GRID_POINTS = 400
BRACKET_ROWS = 1_000_000


@dataclass
class _Bracket:
    """A closed value range that holds both order statistics around one quantile."""

    column: str
    prob: float
    low: float
    high: float
    size: float
    settled: bool = False

    def inside(self) -> Column:
        return number(self.column).between(F.lit(self.low), F.lit(self.high))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    n_rows: int | None = None,
    counts: Mapping[str, int] | None = None,
    direct_rows: int = DIRECT_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; NULLs are ignored, an all-NULL column gives None.

    ``n_rows`` and the ``counts`` of present values are used if they are known already.
    """
    if not columns:
        return {}
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= direct_rows:
        if counts is None:
            row = df.agg(*[F.count(number(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
            counts = {c: row[i] for i, c in enumerate(columns)}
        return _by_value(df, list(columns), [float(p) for p in probs], counts)
    return _bracketed(df, list(columns), [float(p) for p in probs], bracket_rows)


def _by_value(df, columns, probs, counts):
    """At most ``direct_rows`` values per column are ordered, one column per task."""
    slots = [str(i) for i in range(len(columns))]
    narrow = df.select(*[number(c).alias(s) for s, c in zip(slots, columns, strict=True)])
    stacked = spread_small(narrow, max(counts.values())).unpivot([], slots, "slot", "v")
    tallied = stacked.filter("v IS NOT NULL").groupBy(F.col("slot").cast("int").alias("slot"), "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picks = []
    for j, p in enumerate(probs):
        ranks = [_ranks(max(counts[c], 1), p) for c in columns]
        for side, end in enumerate(("low", "high")):
            rank = F.array(*[F.lit(r[side]) for r in ranks])[F.col("slot")]
            picks.append(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(f"{end}{j}"))
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for row in tallied.select("slot", "v", F.sum("n").over(order).alias("upto")).groupBy("slot").agg(*picks).collect():
        column = columns[row["slot"]]
        shares = [_ranks(counts[column], p)[2] for p in probs]
        out[column] = [
            row[f"low{j}"] + (row[f"high{j}"] - row[f"low{j}"]) * share for j, share in enumerate(shares)
        ]
    return out


def _bracketed(df, columns, probs, bracket_rows):
    slack = 2.0 / SKETCH_ACCURACY
    asked = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    first = df.agg(
        *[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(number(c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(number(c)).alias(f"z{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(number(c), asked, SKETCH_ACCURACY).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    brackets = []
    for i, c in enumerate(columns):
        if not counts[c]:
            continue
        for j, p in enumerate(probs):
            # A rank at the very edge is below the sketch's error, so the true extreme bounds it.
            low = first[f"a{i}"] if p - slack <= 0 else first[f"s{i}"][2 * j]
            high = first[f"z{i}"] if p + slack >= 1 else first[f"s{i}"][2 * j + 1]
            brackets.append(_Bracket(c, p, low, high, 2 * slack * counts[c]))
    _narrow(df, brackets, counts, bracket_rows)
    found = _count_inside(df, brackets, counts)
    return {c: [found.get((c, p)) for p in probs] for c in columns}


def _ranks(count: int, prob: float) -> tuple[int, int, float]:
    position = (count - 1) * prob
    low = math.floor(position)
    return low, math.ceil(position), position - low


def _narrow(df, brackets, counts, bracket_rows):
    grid = [k / GRID_POINTS for k in range(GRID_POINTS + 1)]
    while True:
        wide = [b for b in brackets if not b.settled and b.low < b.high and b.size > bracket_rows]
        if not wide:
            return
        row = df.agg(
            *[F.count_if(number(b.column) < F.lit(b.low)).alias(f"b{i}") for i, b in enumerate(wide)],
            *[F.count_if(b.inside()).alias(f"n{i}") for i, b in enumerate(wide)],
            *[
                F.percentile_approx(F.when(b.inside(), number(b.column)), grid, SKETCH_ACCURACY).alias(f"g{i}")
                for i, b in enumerate(wide)
            ],
        ).first()
        for i, b in enumerate(wide):
            below, inside, points = row[f"b{i}"], row[f"n{i}"], row[f"g{i}"]
            first, last, _ = _ranks(counts[b.column], b.prob)
            start = math.floor(GRID_POINTS * (first - below) / inside) - 1
            end = math.ceil(GRID_POINTS * (last + 1 - below) / inside) + 1
            low = b.low if start <= 0 else points[start]
            high = b.high if end >= GRID_POINTS else points[end]
            # One value may fill the bracket; counting it exactly is cheap then, as it combines map-side.
            b.settled = (low, high) == (b.low, b.high)
            b.low, b.high = low, high
            b.size = inside * (end - start) / GRID_POINTS


def _count_inside(df, brackets, counts):
    slots = [
        F.when(number(b.column) < F.lit(b.low), F.struct(F.lit(i).alias("slot"), F.lit(None).cast("double").alias("v")))
        .when(b.inside(), F.struct(F.lit(i).alias("slot"), number(b.column).alias("v")))
        for i, b in enumerate(brackets)
    ]
    if not slots:
        return {}
    # Rows below a bracket fall into one NULL entry per slot, so ranks stay absolute.
    entries = df.select(F.explode(F.array_compact(F.array(*slots))).alias("e")).select("e.slot", "e.v")
    tallied = entries.groupBy("slot", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("slot").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first_rank = F.create_map(*[F.lit(x) for i, b in enumerate(brackets) for x in (i, _ranks(counts[b.column], b.prob)[0])])
    last_rank = F.create_map(*[F.lit(x) for i, b in enumerate(brackets) for x in (i, _ranks(counts[b.column], b.prob)[1])])
    picked = (
        tallied.withColumn("upto", upto)
        .groupBy("slot")
        .agg(
            F.max(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
            F.min(F.when(F.col("upto") > first_rank[F.col("slot")], F.col("v"))).alias("x0"),
            F.min(F.when(F.col("upto") > last_rank[F.col("slot")], F.col("v"))).alias("x1"),
        )
    )
    found = {}
    for row in picked.collect():
        b = brackets[row["slot"]]
        first, _, share = _ranks(counts[b.column], b.prob)
        if row["x0"] is None or row["x1"] is None or (row["below"] or 0) > first:
            raise RuntimeError(f"quantile bracket of {b.column} missed its rank")
        found[(b.column, b.prob)] = row["x0"] + (row["x1"] - row["x0"]) * share
    return found
