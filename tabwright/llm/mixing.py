"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Among all document rates with the wanted tokens per source, the ones nearest to 1 in relative entropy, with rates up to
``most``, are ``min(most, exp(dual * size / mean size))``: one dual value per source. A Newton iteration over the
counts per (source, size) finds the dual values; rates become whole copies along the sizes of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import n_words, ranked, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
TOLERANCE = 1e-7
ITERATIONS = 60
ROUNDING_PASSES = 6


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``_key, source_size, target, _mean`` per source, from rows ``_key, size, _n``.

    Weights repeat along the sources by code point, the null source (empty key) last. A target is the smaller of
    ``most`` times the source's size and a level times its weight, the level being such that all add up to ``share``
    of all sizes: what resharing the excess by weight ends in. One row per source goes through one task.
    """
    total = sizes.groupBy("_key").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("_docs"))
    order = Window.orderBy(F.col("_key") == "", "_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    known = total.withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * most)
    known = known.withColumn("_fills", F.col("_cap") / F.col("_weight"))
    earlier = Window.orderBy("_fills", "_key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_fills", "_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    wanted = F.sum(F.col("source_size").cast("double")).over(everything) * share
    known = known.withColumn("_level", (wanted - spent) / F.sum("_weight").over(onward))
    first = F.min(F.when(F.col("_level") <= F.col("_fills"), F.struct("_fills", "_key", "_level"))).over(everything)
    level = first["_level"]
    target = F.least("_cap", F.coalesce(level * F.col("_weight"), F.col("_cap")))
    return known.select("_key", "source_size", target.alias("target"), (F.col("source_size") / F.col("_docs")).alias("_mean"))


def rate(most: int):
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), F.col("_dual") * F.col("size") / F.col("_mean"))))


def exact_sum(column):
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(column.cast("decimal(38, 9)")).cast("double")


def solved(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with the dual value of each. A step outside the bracket known so far halves the bracket instead."""
    state = sources.select(
        "*", F.lit(0.0).alias("_dual"), F.lit(-60.0).alias("_low"), F.lit(60.0).alias("_high"),
        (F.col("target") >= F.col("source_size") * most).alias("_full"), F.lit(False).alias("_done"),
    )
    state = written(state.withColumn("_dual", F.when(F.col("_full"), 700.0).otherwise(F.col("_dual"))))
    for _ in range(ITERATIONS):
        tokens = F.col("_n") * F.col("size") * rate(most)
        slope = F.when(rate(most) < most, tokens * F.col("size") / F.col("_mean")).otherwise(0.0)
        open_ = state.filter(~(F.col("_full") | F.col("_done")))
        sums = classes.join(open_, "_key").groupBy("_key").agg(exact_sum(tokens).alias("_sum"), exact_sum(slope).alias("_slope"))
        state = state.join(sums, "_key", "left")
        over = F.col("_sum") > F.col("target")
        low, high = F.when(over, F.col("_low")).otherwise(F.col("_dual")), F.when(over, F.col("_dual")).otherwise(F.col("_high"))
        step = F.col("_dual") + (F.log("target") - F.log("_sum")) * F.col("_sum") / F.col("_slope")
        state = state.withColumn("_low", low).withColumn("_high", high).withColumn("_step", step)
        inside = (F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high"))
        done = F.abs(F.col("_sum") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = F.when(inside, F.col("_step")).otherwise((F.col("_low") + F.col("_high")) / 2)
        stays = F.col("_full") | F.col("_done") | F.coalesce(done, F.lit(True))
        state = state.withColumn("_dual", F.when(stays, F.col("_dual")).otherwise(moved)).withColumn("_done", stays)
        state = written(state.drop("_step", "_sum", "_slope"))
        if state.filter(~F.col("_done")).isEmpty():
            break
    return state


def whole_copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Copies per class (``_copies``): the whole numbers passed by a source's running sum of expected copies, in order of
    size, so that any range of sizes gets its expected copies to within one. The sum starts at a hash of the source.
    The remaining error, at most about one document of the largest size, is made up by classes whose size fits in it,
    largest first."""
    own, by_size = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy(F.desc("size"))
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.col("_key"), F.lit("start")), F.lit(1 << 20)) / F.lit(1 << 20)
    running = F.sum("_expected").over(Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    classes = classes.withColumn("_expected", F.col("_n") * rate(most)).withColumn("_passed", F.floor(start + running))
    passed = F.col("_passed") - F.coalesce(F.lag("_passed").over(Window.partitionBy("_key").orderBy("size")), F.lit(0))
    classes = classes.withColumn("_copies", F.least(F.col("_n") * most, passed.cast("long"))).drop("_expected", "_passed")
    goal = F.round("target", 0).cast("long")
    for _ in range(ROUNDING_PASSES):
        classes = classes.withColumn("_error", goal - F.sum(F.col("_copies") * F.col("size")).over(own))
        room = F.when(F.col("_error") > 0, F.col("_n") * most - F.col("_copies")).otherwise(F.col("_copies"))
        classes = classes.withColumn("_room", F.when(F.col("size") <= F.abs("_error"), room).otherwise(0))
        left = F.abs("_error") - F.coalesce(F.sum(F.col("_room") * F.col("size")).over(before), F.lit(0))
        flips = F.least(F.col("_room"), F.greatest(F.lit(0), F.floor(left / F.col("size")).cast("long")))
        classes = classes.withColumn("_copies", F.col("_copies") + F.signum("_error").cast("long") * flips)
    return classes.drop("_error", "_room")


def sized(docs: DataFrame) -> DataFrame:
    """``_row`` (the row as it is), ``doc_id, _key, size`` and a hash of the text."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))
    return docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key"),
        n_words(text).alias("size"), F.xxhash64(text).alias("_tie"),
    )


def class_copies(sizes: DataFrame, weights: tuple, share: float, most: int) -> DataFrame:
    """``_key, size, _n, _copies, source_size, target``: a row per source and size, as a written table."""
    classes = written(sizes.groupBy("_key", "size").agg(F.count("*").alias("_n")))
    sources = written(targets(classes, weights, share, most))
    filled = classes.filter("size > 0")
    duals = solved(filled, sources.filter("target > 0"), most).select("_key", "_dual", "_mean", "target")
    copies = whole_copies(filled.join(duals, "_key"), most).select("_key", "size", "_copies")
    counted = classes.join(copies, ["_key", "size"], "left").join(sources.drop("_mean"), "_key")
    empty = F.when(F.col("size") == 0, F.col("_n"))
    return written(counted.withColumn("_copies", F.coalesce(empty, F.col("_copies"), F.lit(0))))


def handed_out(sizes: DataFrame, counted: DataFrame) -> DataFrame:
    """``sizes`` with ``source_size, target, copies``: the copies of a class go to its documents as evenly as can be."""
    rows = counted.agg(F.sum("_n")).first()[0] or 0
    in_rank = ranked(sizes, ["_key", "size"], ["doc_id", "_tie"], "_rank", rows).join(counted, ["_key", "size"])
    copies = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_rank") < F.col("_copies") % F.col("_n")).cast("long")
    return in_rank.withColumn("copies", copies.cast("long")).drop("_rank", "_n", "_copies", "_key", "_tie")


def entropy_balance(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` (0 to ``most``) per row of ``docs``.

    The null source is a source of its own, the last. Texts without a word (null, empty) have size 0 and one copy, as
    they add nothing to a target. Repeated rows are separate documents. An empty table gives no rows. Reruns agree:
    sums are exact and the order of the documents within a class is a hash of their ids.
    """
    sizes = written(sized(docs).drop("_row"))
    return handed_out(sizes, class_copies(sizes, weights, share, most))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; with the cases of `entropy_balance`."""
    counted = class_copies(sized(docs).drop("_row"), weights, share, most)
    taken = handed_out(sized(docs), counted).filter("copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
