"""One pass over a table gives a small state per column: counts, moments, distinct values, smallest texts.

Each partition makes one state per column; states merge in any order, so they are joined in a tree and the result has one
row per column. Values travel as 64-bit hashes. Up to ``EXACT_VALUES`` different ones are counted each, beyond that a
HyperLogLog sketch estimates how many there are.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import kind_of, nan_to_null, number, quoted, typed_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

EXACT_VALUES = 2048
#: 2^14 registers: a standard error of 0.81 %.
PRECISION = 14
REGISTERS = 1 << PRECISION
ERROR = 1.04 / math.sqrt(REGISTERS)
#: Estimates are taken as sure within this many standard errors: one in 16,000 lies outside.
SURE = 4
#: States merged by one task of the first level.
FAN_IN = 500
PARTIAL = (
    "cid int, part int, n bigint, present bigint, mean double, squares double, low double, high double, "
    "hashes array<bigint>, counts array<bigint>, registers binary, smallest array<string>"
)
FINAL = (
    "cid int, n bigint, present bigint, mean double, squares double, low double, high double, n_values bigint, exact boolean, "
    "top_hash bigint, top_count bigint, least_count bigint, smallest array<string>"
)


# ---- distinct values ---------------------------------------------------------------------------------------------


def registered(registers: np.ndarray, hashes: np.ndarray) -> None:
    """Note hashes in the sketch: the first bits choose a register, the run of zeros after them is what it may hold."""
    bits = hashes.view(np.uint64)
    rest = (bits << np.uint64(PRECISION)) | np.uint64(1 << (PRECISION - 1))
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]
    np.maximum.at(registers, (bits >> np.uint64(64 - PRECISION)).astype(np.int64), (zeros + 1).astype(np.uint8))


def estimated(registers: np.ndarray) -> float:
    """Number of different hashes noted, by the estimator for the whole range from few to many."""
    most = 64 - PRECISION
    held = np.bincount(registers, minlength=most + 2).astype(float)
    # Full registers, from their share x: x + sum of (1 - x^(1/2^k))^2 / 2^k, as a series.
    x = 1 - held[most + 1] / REGISTERS
    z = 0.0
    if 0 < x < 1:
        y, z = 1.0, 1 - x
        while True:
            x, before = math.sqrt(x), z
            y *= 0.5
            z -= (1 - x) ** 2 * y
            if z == before:
                break
        z /= 3
    z *= REGISTERS
    for k in range(most, 0, -1):
        z = 0.5 * (z + held[k])
    # Empty registers: x + sum of x^(2^k) * 2^(k-1).
    x = held[0] / REGISTERS
    if x == 1:
        return 0.0
    y, empty = 1.0, x
    while True:
        x, before = x * x, empty
        empty += x * y
        y += y
        if empty == before:
            break
    return REGISTERS * REGISTERS / (2 * math.log(2) * (z + REGISTERS * empty))


@dataclass
class State:
    """What is known of a column in some of its rows."""

    n: int = 0
    present: int = 0
    moments: tuple[int, float, float, float, float] | None = None  # numbers, mean, squared deviations, least, greatest
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    registers: np.ndarray | None = None
    smallest: list[str] = field(default_factory=list)

    def add_values(self, hashes: np.ndarray, counts: np.ndarray | None = None) -> None:
        if self.registers is not None:
            registered(self.registers, hashes)
            return
        counts = np.ones(len(hashes), np.int64) if counts is None else counts
        together = np.concatenate([self.hashes, hashes])
        self.hashes, place = np.unique(together, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.hashes)).astype(np.int64)
        if len(self.hashes) > EXACT_VALUES:
            self.registers = np.zeros(REGISTERS, np.uint8)
            registered(self.registers, self.hashes)
            self.hashes = self.counts = np.zeros(0, np.int64)

    def add_moments(self, count: int, mean: float, squares: float, low: float, high: float) -> None:
        if not count:
            return
        if self.moments is None:
            self.moments = (count, mean, squares, low, high)
            return
        n, m, s, least, greatest = self.moments
        total, apart = n + count, mean - m
        self.moments = (total, m + apart * count / total, s + squares + apart * apart * n * count / total, min(low, least), max(high, greatest))

    def add_smallest(self, texts: list[str], wanted: int) -> None:
        self.smallest = sorted({*self.smallest, *texts}, key=lambda t: t.encode("utf-8", "surrogatepass"))[:wanted]

    def add(self, other: State, wanted: int) -> None:
        self.n += other.n
        self.present += other.present
        if other.moments:
            self.add_moments(*other.moments)
        if other.registers is not None:
            if self.registers is None:
                self.registers = np.zeros(REGISTERS, np.uint8)
                registered(self.registers, self.hashes)
                self.hashes = self.counts = np.zeros(0, np.int64)
            self.registers = np.maximum(self.registers, other.registers)
        else:
            self.add_values(other.hashes, other.counts)
        self.add_smallest(other.smallest, wanted)

    def row(self) -> tuple:
        _, mean, squares, low, high = self.moments or (0, None, None, None, None)
        registers = None if self.registers is None else self.registers.tobytes()
        return self.n, self.present, mean, squares, low, high, self.hashes.tolist(), self.counts.tolist(), registers, self.smallest

    @staticmethod
    def of(row) -> State:
        known = not pd.isna(row.mean)
        return State(
            int(row.n), int(row.present), (int(row.present), row.mean, row.squares, row.low, row.high) if known else None,
            np.array(row.hashes, np.int64), np.array(row.counts, np.int64),
            None if row.registers is None else np.frombuffer(row.registers, np.uint8).copy(), list(row.smallest),
        )


# ---- over a table ------------------------------------------------------------------------------------------------


def value_hash(name: str, data_type: T.DataType) -> Column:
    """A 64-bit hash of a value that is equal for equal values; NULL for NULL."""
    key = typed_key(name, data_type, digest=not isinstance(data_type, T.StringType))
    key = key + F.lit(0.0) if isinstance(data_type, (T.FloatType, T.DoubleType)) else key  # one zero
    return F.when(key.isNotNull(), F.xxhash64(key))


def partial_states(df: DataFrame, columns: Sequence[str], examples: Sequence[str], wanted: int) -> DataFrame:
    """One row per column (by position) and partition."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for i, c in enumerate(columns):
        cells.append(value_hash(c, fields[c]).alias(f"h{i}"))
        if kind_of(fields[c]) in ("int", "float"):
            cells.append(number(c).alias(f"x{i}"))
        if c in examples:
            cells.append(quoted(c).cast("string").alias(f"t{i}"))
    width = len(columns)
    names, types = zip(*(f.split() for f in PARTIAL.split(", ")), strict=True)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [State() for _ in range(width)]
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for i, state in enumerate(states):
                hashes = batch.column(at[f"h{i}"]).drop_null().to_numpy(zero_copy_only=False)
                state.n += batch.num_rows
                state.present += len(hashes)
                state.add_values(hashes)
                if f"x{i}" in at:
                    x = batch.column(at[f"x{i}"]).drop_null().to_numpy(zero_copy_only=False)
                    if len(x):
                        with np.errstate(invalid="ignore", over="ignore"):
                            mean = x.mean()
                            state.add_moments(len(x), float(mean), float(((x - mean) ** 2).sum()), float(x.min()), float(x.max()))
                if f"t{i}" in at:
                    found = pc.unique(batch.column(at[f"t{i}"]).drop_null())
                    first = found.take(pc.select_k_unstable(found, min(wanted, len(found)), [("", "ascending")])) if len(found) else found
                    state.add_smallest(first.to_pylist(), wanted)
        part = TaskContext.get().partitionId()
        rows = [(i, part, *state.row()) for i, state in enumerate(states) if state.n]
        if rows:
            yield pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    return df.select(*cells).mapInArrow(measure, PARTIAL)


def merged_states(states: DataFrame, wanted: int) -> DataFrame:
    """States of partitions to one row per column: by groups of ``FAN_IN`` partitions first, then all."""

    def merge(rows: pd.DataFrame) -> State:
        total = State()
        for row in rows.itertuples():
            total.add(State.of(row), wanted)
        return total

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows.cid.iloc[0], rows.part.iloc[0], *merge(rows).row())], columns=[f.split()[0] for f in PARTIAL.split(", ")])

    def every(rows: pd.DataFrame) -> pd.DataFrame:
        s = merge(rows)
        _, mean, squares, low, high = s.moments or (0, None, None, None, None)
        exact, top = s.registers is None, int(s.counts.argmax()) if len(s.counts) else None
        n_values = len(s.hashes) if exact else round(estimated(s.registers))
        known = (None, None, None) if top is None else (int(s.hashes[top]), int(s.counts[top]), int(s.counts.min()))
        made = (rows.cid.iloc[0], s.n, s.present, mean, squares, low, high, n_values, exact, *known, s.smallest)
        # Whole numbers that may be missing stay whole: pandas would make them floats.
        return pd.DataFrame([made], columns=[f.split()[0] for f in FINAL.split(", ")], dtype=object)

    grouped = states.groupBy("cid", F.floor(F.col("part") / FAN_IN).alias("_group"))
    return grouped.applyInPandas(some, PARTIAL).groupBy("cid").applyInPandas(every, FINAL)


@dataclass
class ColumnState:
    """A column of the whole table. ``n_values`` is a count if ``exact``, else an estimate; the counts of the most and
    the least frequent value are known if it is exact."""

    n: int
    present: int
    moments: dict
    n_values: int
    exact: bool
    top_hash: int | None
    top_count: int | None
    least_count: int | None
    smallest: list[str]

    @property
    def missing(self) -> int:
        return self.n - self.present

    def bounds(self) -> tuple[int, int]:
        """The number of different values lies within."""
        if self.exact:
            return self.n_values, self.n_values
        spread = SURE * ERROR * self.n_values
        return max(EXACT_VALUES + 1, math.floor(self.n_values - spread)), min(self.present, math.ceil(self.n_values + spread))


def column_states(df: DataFrame, columns: Sequence[str] | None = None, examples: Sequence[str] = (), wanted: int = 3) -> dict[str, ColumnState]:
    """The state of each column in one pass over ``df``; ``examples`` names text columns whose smallest texts are wanted.

    An empty table gives states without rows. NaN counts as missing.
    """
    columns = list(columns if columns is not None else df.columns)
    df = nan_to_null(df.select(*[quoted(c) for c in columns]))
    rows = merged_states(partial_states(df, columns, examples, wanted), wanted).collect() if columns else []  # one row per column
    found = {columns[r["cid"]]: r for r in rows}
    out = {}
    for c in columns:
        if (r := found.get(c)) is None:
            out[c] = ColumnState(0, 0, _moments(0, None, None, None, None), 0, True, None, None, None, [])
            continue
        out[c] = ColumnState(
            r["n"], r["present"], _moments(r["present"] if r["mean"] is not None else 0, r["mean"], r["squares"], r["low"], r["high"]),
            r["n_values"], r["exact"], r["top_hash"], r["top_count"], r["least_count"], list(r["smallest"]),
        )
    return out


def _moments(count, mean, squares, low, high) -> dict:
    std = math.sqrt(squares / (count - 1)) if count > 1 else None
    return dict(count=count, mean=mean, std=std, std_pop=math.sqrt(squares / count) if count else None, min=low, max=high)


def top_values(df: DataFrame, hashes: dict[str, int]) -> dict[str, object]:
    """The values behind hashes of their columns, in one pass."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    df = nan_to_null(df)

    def value(c: str) -> Column:
        plain = kind_of(fields[c]) != "other"
        return quoted(c) if plain else typed_key(c, fields[c], digest=False)

    cells = [F.min(F.when(value_hash(c, fields[c]) == F.lit(h), value(c))).alias(str(i)) for i, (c, h) in enumerate(hashes.items())]
    row = df.agg(*cells).first() if cells else []
    return {c: row[i] for i, c in enumerate(hashes)}
