"""Shards of near equal size by a k-d tree over document metadata. DataFrame functions only.

A node is split at the weighted median along its widest dimension until each leaf is one shard. Documents are ordered
by the dimension, then by a hash of the text, then by a chunk number, so that a cut can fall anywhere: at a value, at a
text or, where one text fills more than the tolerance, within its copies. Smaller groups of equal texts stay whole.
Strings are a dimension by their place among the different values.

All nodes of a level are cut together. Medians come from histograms that are refined within the bin of the median; nodes,
brackets and histograms are tables, so the number of leaves may grow with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.lookup import lookup
from tabwright.functions.ordering import number_rows
from tabwright.llm.common import ranked, written

SHARDS = 8
BINS = 1024
CHUNKS = 64
#: A cut may miss the median by this share of its node; to keep the copies of a text together, by the second.
TOLERANCE = 0.001
COPIES_TOLERANCE = 0.02
LAST = (1 << 63) - 1
#: Tables with a row per node are broadcast up to so many nodes.
BROADCAST_NODES = 100_000

#: Metadata dimensions of ``documents``: numbers, or strings that count by their order.
DIMENSIONS = {"n_chars": lambda: F.length("text"), "lang": lambda: F.col("lang"), "source": lambda: F.col("source")}


def points(docs: DataFrame, dimensions: dict) -> DataFrame:
    """A row per document with its size, its text as a hash, and a number per dimension (null: -1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)).cast("long").alias("_chunk"),
        *[make().alias(f"_d{i}") for i, make in enumerate(dimensions.values())],
    )
    for i in range(len(dimensions)):
        name = f"_d{i}"
        if isinstance(rows.schema[name].dataType, T.StringType):
            values = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
            places = written(number_rows(values, [F.col(name)], "_place"))
            rows = lookup(rows, places, [name], "_n").withColumn(name, F.col("_place")).drop("_place")
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast("long"), F.lit(-1).cast("long")))
    return rows


def on_nodes(rows: DataFrame, table: DataFrame, nodes: int, how: str = "inner") -> DataFrame:
    """Join with a table of at most ``nodes`` rows, one per node."""
    return rows.join(F.broadcast(table) if nodes <= BROADCAST_NODES else table, "_node", how)


def first_brackets(grouped: DataFrame, open_: DataFrame, nodes: int, n_dims: int, spans: list[int]) -> DataFrame:
    """The search for the cut of each node in ``open_`` (``_node, shards``): its widest dimension, and all of that."""
    stats = grouped.groupBy("_node").agg(
        F.sum("_weight").alias("total"), *[f(f"_d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("a", F.min), ("b", F.max))]
    )
    widths = F.array(*[(F.col(f"b{i}") - F.col(f"a{i}")) / F.lit(max(1, spans[i])) for i in range(n_dims)])
    dim = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
    found = on_nodes(stats, open_, nodes).withColumn("dim", dim)
    low, high = (F.element_at(F.array(*[f"{n}{i}" for i in range(n_dims)]), F.col("dim") + 1) for n in "ab")
    left = F.floor(F.col("shards") / 2).cast("int")
    none = F.lit(None).cast("long")
    return found.select(
        "_node", "shards", left.alias("left"), "dim", "total", (F.col("total") * left / F.col("shards")).alias("goal"), F.lit(0).cast("long").alias("below"),
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("t"), low.alias("low"), high.alias("high"),
        none.alias("cut_v"), none.alias("cut_t"), none.alias("cut_c"),
    )


def narrowed(grouped: DataFrame, search: DataFrame, nodes: int, n_dims: int) -> DataFrame:
    """One round for the open searches: each bracket becomes the bin that holds the median, or the cut is found.

    The bin is taken whole, or left out, if its weight is within the tolerance or it can't be divided. A bin of one value
    is divided by text, one of one text by chunk.
    """
    open_ = search.filter("cut_v IS NULL").withColumn("width", F.expr(f"(high - low) div {BINS} + 1"))
    value = F.element_at(F.array(*[f"_d{i}" for i in range(n_dims)]), F.col("dim") + 1)
    at = F.when(F.col("depth") == 0, value).when(F.col("depth") == 1, F.col("_text")).otherwise(F.col("_chunk"))
    within = ((F.col("depth") == 0) | (value == F.col("v"))) & ((F.col("depth") < 2) | (F.col("_text") == F.col("t")))
    brackets = open_.select("_node", "dim", "depth", "v", "t", "low", "high", "width")
    held = on_nodes(grouped, brackets, nodes).filter(within & at.between(F.col("low"), F.col("high")))
    bins = held.withColumn("_at", at).groupBy("_node", F.expr("(_at - low) div width").alias("bin")).agg(F.sum("_weight").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("_node").orderBy("bin"))
    counted = on_nodes(bins.withColumn("upto", upto), open_.select("_node", "below", "goal"), nodes)
    reached = F.col("below") + F.col("upto") >= F.col("goal")
    here = F.struct("bin", "w", (F.col("below") + F.col("upto")).alias("upto"))
    hits = counted.groupBy("_node").agg(F.coalesce(F.min(F.when(reached, here)), F.max(here)).alias("hit"))
    told = on_nodes(open_, hits, nodes).select("*", (F.col("low") + F.col("hit.bin") * F.col("width")).alias("first"))
    last = F.least(F.col("high"), F.col("first") + F.col("width") - 1)
    before = F.col("hit.upto") - F.col("hit.w")
    single = F.col("width") == 1
    tolerance = F.when(single & (F.col("depth") == 1), F.lit(COPIES_TOLERANCE)).otherwise(F.lit(TOLERANCE))
    done = (F.col("hit.w") <= tolerance * F.col("total")) | (single & (F.col("depth") == 2))
    nearer = F.col("goal") - before > F.col("hit.upto") - F.col("goal")
    edge = F.when(nearer, last).otherwise(F.col("first") - 1)
    deeper = ~done & single
    end = F.lit(LAST)
    step = told.select(
        "_node", "shards", "left", "dim", "total", "goal", before.alias("below"),
        F.when(deeper, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
        F.when(deeper & (F.col("depth") == 0), F.col("first")).otherwise(F.col("v")).alias("v"),
        F.when(deeper & (F.col("depth") == 1), F.col("first")).otherwise(F.col("t")).alias("t"),
        F.when(deeper, F.lit(0).cast("long")).otherwise(F.col("first")).alias("low"),
        F.when(deeper & (F.col("depth") == 0), end).when(deeper, F.lit(CHUNKS - 1).cast("long")).otherwise(last).alias("high"),
        F.when(done, F.when(F.col("depth") == 0, edge).otherwise(F.col("v"))).alias("cut_v"),
        F.when(done, F.when(F.col("depth") == 0, end).when(F.col("depth") == 1, edge).otherwise(F.col("t"))).alias("cut_t"),
        F.when(done, F.when(F.col("depth") == 2, edge).otherwise(end)).alias("cut_c"),
    )
    return search.filter("cut_v IS NOT NULL").unionByName(step)


def split_once(grouped: DataFrame, tree: DataFrame, nodes: int, n_dims: int, spans: list[int]) -> tuple[DataFrame, DataFrame]:
    """All nodes of ``tree`` (``_node, shards``) with several shards cut in two: the rows with their new nodes, and the nodes."""
    search = written(first_brackets(grouped, tree.filter("shards > 1"), nodes, n_dims, spans))
    while not search.filter("cut_v IS NULL").isEmpty():
        search = written(narrowed(grouped, search, nodes, n_dims))
    cuts = search.select("_node", "dim", "cut_v", "cut_t", "cut_c", (F.col("_node") + F.col("left")).alias("right"))
    value = F.element_at(F.array(*[f"_d{i}" for i in range(n_dims)]), F.col("dim") + 1)
    beyond = (value > F.col("cut_v")) | ((value == F.col("cut_v")) & (
        (F.col("_text") > F.col("cut_t")) | ((F.col("_text") == F.col("cut_t")) & (F.col("_chunk") > F.col("cut_c")))))
    split = on_nodes(grouped, cuts, nodes, "left")
    node = F.when(beyond, F.col("right")).otherwise(F.col("_node"))
    rows = written(split.select("_text", "_chunk", "_weight", *[f"_d{i}" for i in range(n_dims)], node.alias("_node")))
    halves = search.select("_node", F.col("left").alias("_left"))
    parts = F.array(F.struct("_node", F.col("_left").alias("shards")), F.struct((F.col("_node") + F.col("_left")).alias("_node"), (F.col("shards") - F.col("_left")).alias("shards")))
    # A node without rows, or with one shard, is done.
    whole = F.array(F.struct("_node", F.lit(1).alias("shards")))
    below = on_nodes(tree, halves, nodes, "left").select(F.inline(F.when(F.col("_left").isNull(), whole).otherwise(parts)))
    return rows, written(below.select("_node", F.col("shards").cast("int").alias("shards")))


def kd_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, dimensions: dict | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of ``docs``.

    With ``target_bytes`` the number of leaves follows from the size of the table. Null and empty texts have size 1 and
    are equal texts; a null in a dimension comes before all values. Repeated rows are separate documents. Tables with
    fewer texts than shards leave shards empty; an empty table gives no rows. Broadcasts hold a row per node.
    """
    dimensions = dimensions or DIMENSIONS
    n_dims = len(dimensions)
    rows = written(points(docs, dimensions))
    dims = [f"_d{i}" for i in range(n_dims)]
    # Copies may differ in their metadata: they all take the smallest values, so that their group is one place.
    grouped = rows.groupBy("_text", "_chunk").agg(F.sum("size").alias("_weight"), F.count("*").alias("_rows"), *[F.min(d).alias(d) for d in dims])
    lowest = grouped.groupBy("_text").agg(*[F.min(d).alias(d) for d in dims])
    grouped = grouped.drop(*dims).join(lowest, "_text").withColumn("_node", F.lit(0))
    grouped = written(grouped)
    r = grouped.agg(F.sum("_rows").alias("n"), F.sum("_weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    if target_bytes:
        shards = max(1, -(-(r.w or 0) // target_bytes))
    tree = docs.sparkSession.range(1).select(F.lit(0).alias("_node"), F.lit(shards).alias("shards"))
    for _ in range(math.ceil(math.log2(shards)) if r.n else 0):
        grouped, tree = split_once(grouped, tree, shards, n_dims, [r[d] or 0 for d in dims])
    placed = rows.join(grouped.select("_text", "_chunk", F.col("_node").alias("shard")), ["_text", "_chunk"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32"], "slot", r.n or 0)
