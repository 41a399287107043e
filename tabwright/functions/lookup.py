"""Joining a fitted table (one row per key) onto many rows, whatever the sizes and however hot a key is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import quoted
from tabwright.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of one key that go to one task of a shuffle join, about.
KEY_ROWS = 1_000_000
#: Keys that are split are known to all tasks by a hash and a number: at most so many of them.
SPLIT_KEYS = 2_000_000
ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def table_bytes(table: DataFrame) -> int:
    """The size of ``table`` itself, not an estimate of it."""
    width = F.lit(16 * len(table.columns))
    for name, dtype in table.dtypes:
        if dtype == "string":
            width = width + F.coalesce(F.octet_length(quoted(name)), F.lit(0))
        elif dtype.startswith(("array", "struct", "map")):
            width = width + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(quoted(name)))), F.lit(0))
    return table.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return table_bytes(table) <= limit


def split_keys(rows: DataFrame, on: Sequence[str], key_rows: int = KEY_ROWS, most: int = SPLIT_KEYS) -> DataFrame:
    """``_key, _parts`` for keys (by hash) that more than ``key_rows`` of ``rows`` have: into how many parts they go.

    At most ``most`` keys: where more are that frequent, the bound rises to the next power of two that fits. So a part has
    about ``max(key_rows, rows / most)`` rows, and the table at most 16 bytes times ``most``, whatever the keys are.
    """
    held = rows.filter(~any_null(on)).groupBy(F.xxhash64(*[quoted(c) for c in on]).alias("_key")).agg(F.count("*").alias("_n"))
    over = cut_lineage(held.filter(F.col("_n") > key_rows))
    levels = over.groupBy(F.floor(F.log2("_n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    total, bound = 0, key_rows
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            bound = max(bound, 1 << (row["level"] + 1))
            break
    return over.filter(F.col("_n") > bound).select("_key", F.ceil(F.col("_n") / F.lit(bound)).cast("int").alias("_parts"))


def any_null(on: Sequence[str]) -> Column:
    missing = F.lit(False)
    for c in on:
        missing = missing | quoted(c).isNull()
    return missing


def salted(rows: DataFrame, on: Sequence[str], parts: DataFrame) -> DataFrame:
    """``rows`` with ``_part``: below the number of parts of their key; rows without a key are spread and match nothing.

    The part follows from the values of a row and its input partition, so a task that is run again gives the same.
    """
    plain = [quoted(f.name) for f in rows.schema.fields if isinstance(f.dataType, ATOMIC)]
    spread = F.xxhash64(F.spark_partition_id(), *plain)
    found = rows.withColumn("_key", F.xxhash64(*[quoted(c) for c in on])).join(F.broadcast(parts), "_key", "left")
    part = F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")
    return found.withColumn("_part", F.when(any_null(on), -1 - F.spark_partition_id()).otherwise(part)).drop("_key", "_parts")


def repeated(table: DataFrame, on: Sequence[str], parts: DataFrame) -> DataFrame:
    """``table`` with ``_part``: a row for each part of its key."""
    found = table.withColumn("_key", F.xxhash64(*[quoted(c) for c in on])).join(F.broadcast(parts), "_key", "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return found.withColumn("_part", every).drop("_key", "_parts")


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], count: str, broadcast_bytes: int = BROADCAST_BYTES, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Left join of ``rows`` with a ``table`` unique in ``on``; ``count`` is the table's column of key counts.

    ``table`` is read several times, so an expensive one should have been written out. A table of checked size is
    broadcast. Otherwise it is joined by a shuffle on the key and a part: keys that many of ``rows`` have, also ones the
    table lacks, are split into parts of about ``key_rows`` rows, and the table's row is repeated for each part.
    """
    on = list(on)
    values = [c for c in table.columns if c not in on and c != count]
    if fits_broadcast(table, broadcast_bytes):
        return rows.join(F.broadcast(table.drop(count)), on, "left").select(*[quoted(c) for c in rows.columns], *values)
    # Equal keys must have equal hashes, so they need one type.
    table = table.withColumns({c: quoted(c).cast(rows.schema[c].dataType) for c in on})
    parts = split_keys(rows, on, key_rows)
    joined = salted(rows, on, parts).join(repeated(table.drop(count), on, parts), [*on, "_part"], "left")
    return joined.select(*[quoted(c) for c in rows.columns], *values)
