"""Repeatable splits and folds.

The order of rows is the md5 of a seed and the row's key columns, so a split does not depend on partitioning and
survives a lost executor. The first rows of a class are found through a cut-off key per class, by counting; no class
is ever sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.functions.lookup import fits_broadcast, lookup
from tabwright.functions.ordering import cut_keys, replicate, shuffle_key
from tabwright.session import cut_lineage

TRAIN, TEST = "train", "test"
HEX15 = 16**15


def test_quota(n: Column, test_size: float) -> Column:
    """Test rows of a class of ``n``: rounded, at least one on each side if there are two rows, else none."""
    wanted = F.round(n * F.lit(float(test_size))).cast("bigint")
    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.least(wanted, (n - 1).cast("bigint")))
    )


def first_rows(
    df: DataFrame, group: Column, quotas: DataFrame, keys: Sequence[str] | None, seed: int
) -> DataFrame:
    """Add ``part``: 0 for the first rows of the group, 1 for the next, and so on; NULL for groups without quota.

    ``quotas`` has ``_group, part, quota``: the number of rows in parts 0..part together. Without ``keys`` rows are
    told apart by all their columns, and equal rows are interchangeable: those at a cut-off are made anew in the right
    numbers.
    """
    keyed = df.withColumns({"_group": group, "_key": shuffle_key(seed, keys, df)})
    cuts = cut_lineage(cut_keys(keyed.select("_group", "_key"), "_group", quotas))
    shared = cuts.filter(F.col("taken") < F.col("copies")).limit(1).count() > 0
    if shared and keys:
        raise ValueError(f"columns {list(keys)} do not tell all rows apart; add columns or leave them out")
    ordered = cuts.groupBy("_group").agg(
        F.array_sort(F.collect_list(F.struct("part", "cut", "taken", "copies"))).alias("_cuts")
    )
    if fits_broadcast(ordered):
        joined = keyed.join(F.broadcast(ordered), "_group", "left")
    else:
        sizes = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
        joined = lookup(keyed, cut_lineage(ordered.join(sizes, "_group")), ["_group"], "_n")
    # Groups without a cut-off get no part.
    passed = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: F.col("_key") > c["cut"])))
    if not shared:
        return joined.withColumn("part", passed).drop("_group", "_key", "_cuts")
    split_key = F.exists("_cuts", lambda c: (F.col("_key") == c["cut"]) & (c["taken"] < c["copies"]))
    split_key = F.coalesce(split_key, F.lit(False))
    whole = joined.filter(~split_key).withColumn("part", passed).drop("_group", "_key", "_cuts")
    # Equal rows on a cut-off: one representative, its copies dealt to the parts by number.
    at_cut = joined.filter(split_key).dropDuplicates(["_group", "_key"])
    ends = F.transform(F.filter("_cuts", lambda c: c["cut"] == F.col("_key")), lambda c: c["taken"])
    numbers = F.array_distinct(F.transform("_cuts", lambda c: F.when(c["cut"] == F.col("_key"), c["copies"])))
    total = F.array_max(numbers)
    dealt = at_cut.withColumns({"_ends": F.concat(ends, F.array(total)), "_base": passed})
    dealt = dealt.select("*", F.posexplode("_ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.lit(0).cast("bigint")).otherwise(F.element_at("_ends", F.col("_i")))
    dealt = dealt.withColumns({"part": F.col("_base") + F.col("_i"), "_times": F.col("_end") - start})
    dealt = replicate(dealt.filter("_times > 0").select(*df.columns, "part", "_times"), "_times")
    return whole.unionByName(dealt)


def stratified_split(
    df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42, keys: Sequence[str] | None = None
) -> DataFrame:
    """Add ``split``: in every class ``round(test_size * n)`` rows are test rows."""
    counts = df.groupBy(quoted(target).alias("_group")).agg(F.count("*").alias("_n"))
    quotas = counts.select("_group", F.lit(0).alias("part"), test_quota(F.col("_n"), test_size).alias("quota"))
    parts = first_rows(df, quoted(target), quotas.filter("quota > 0"), keys, seed)
    is_test = F.coalesce(F.col("part") == 0, F.lit(False))
    return parts.withColumn("split", F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN))).select(*df.columns, "split")


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Add ``split`` by a hash of the row: about ``test_size`` of the rows are test rows, without any shuffle."""
    draw = F.conv(F.substring(shuffle_key(seed, keys, df), 1, 15), 16, 10).cast("bigint")
    is_test = draw < F.lit(int(test_size * HEX15))
    return df.withColumn("split", F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def exact_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Add ``split`` with ``round(test_size * n)`` test rows of the whole table."""
    return stratified_split(df.withColumn("_all", F.lit(1)), "_all", test_size, seed, keys).drop("_all")


def fold_count(smallest_class: int, most: int = 5) -> int:
    """Cross-validation folds: up to five, as many as the smallest class allows, and never less than two."""
    return min(most, smallest_class) if smallest_class >= 2 else 2


def stratified_folds(
    df: DataFrame, target: str, k: int | None = None, seed: int = 42, keys: Sequence[str] | None = None
) -> DataFrame:
    """Add ``fold`` 0..k-1; within a class fold sizes differ by one at most, the first folds being the larger."""
    counts = df.groupBy(quoted(target).alias("_group")).agg(F.count("*").alias("_n"))
    if k is None:
        k = fold_count(counts.agg(F.min("_n")).first()[0] or 0)
    step = F.floor(F.col("_n") / F.lit(k))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)),
        lambda j: F.struct((j - 1).alias("part"), (j * step + F.least(j, F.col("_n") % k)).cast("bigint").alias("quota")),
    )
    quotas = counts.select("_group", F.inline(ends)).filter("quota > 0")
    return first_rows(df, quoted(target), quotas, keys, seed).withColumnRenamed("part", "fold")
