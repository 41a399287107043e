"""Exact k-nearest-neighbour classification over a pivot index.

Equal training points are merged into one with a count. The points lie in cells around the centres of a k-means fit, and
each cell is cut into shells by distance from its centre. By the triangle inequality a query is at least as far from the
points of a shell as its own distance from the centre is outside the shell's range. A query first looks into the nearest
shells that hold k points, which bounds its k-th distance, and then only into shells that may hold a nearer point.

Centres come from a bounded sample and only decide how much can be skipped, never what is found. Shells and queries are
split into blocks of bounded size; a (shell block, query block) pair is one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import quoted
from tabwright.functions.lookup import lookup
from tabwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

#: Points of a shell, about; points or queries of a block, at most about.
SHELL_ROWS = 1024
BLOCK_ROWS = 4096
#: Bounds of the index that every task holds: cells, and shells of a cell. Beyond them shells grow and are cut into blocks.
MOST_CELLS = 1024
MOST_SHELLS = 64
#: Points the centres are fitted on, per cell.
SAMPLE_PER_CELL = 100
CENTRE_ROUNDS = 5
RELATIVE_SLACK = 1e-9
#: Numbers in one matrix of a task.
MATRIX_CELLS = 4_000_000


def as_array(df: DataFrame, features: str) -> Column:
    x = quoted(features)
    return x.cast("array<double>") if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(x)


def block_search(k: int, relative_slack: float = RELATIVE_SLACK):
    """The per-block search: ``f(queries, points, labels, within)`` gives ``(query, point, squared distance)`` index arrays
    of every point that can be among the k nearest of a query, and not beyond its squared distance ``within``.

    A matrix product ranks the points; those within rounding error of the k-th are measured again exactly.
    """

    def neighbours(queries: np.ndarray, points: np.ndarray, labels: np.ndarray, within: np.ndarray | None = None):
        within = np.full(len(queries), np.inf) if within is None else within
        norm_q, norm_p = (queries**2).sum(1), (points**2).sum(1)
        wanted = min(k, points.shape[0])
        step = max(1, MATRIX_CELLS // max(1, len(points)))
        found = []
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            rough = norm_q[part, None] + norm_p[None, :] - 2.0 * (queries[part] @ points.T)
            limit = np.minimum(np.partition(rough, wanted - 1, axis=1)[:, wanted - 1], within[part])
            slack = relative_slack * (norm_q[part] + norm_p.max() + 1.0)
            q, p = np.nonzero(rough <= (limit + slack)[:, None])
            found.append((q + at, p))
        q, p = (np.concatenate(x) for x in zip(*found, strict=True))
        exact = ((queries[q] - points[p]) ** 2).sum(1)
        near = exact <= within[q]
        q, p, exact = q[near], p[near], exact[near]
        order = np.lexsort((p, labels[p], exact, q))
        q, p, exact = q[order], p[order], exact[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < wanted
        return q[keep], p[keep], exact[keep]

    return neighbours


# ---- the index ---------------------------------------------------------------------------------------------------


def centre_distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows from all centres by a matrix product, and a bound of their rounding error."""
    norm_x, norm_c = (x**2).sum(1), (centres**2).sum(1)
    error = 1e-12 * (norm_x + norm_c.max() + 1.0)
    return norm_x[:, None] + norm_c[None, :] - 2.0 * (x @ centres.T), error


@dataclass
class Index:
    """Centres, and per shell its cell, the range of distances from the centre, its points and their copies."""

    centres: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray
    copies: np.ndarray

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """Per query and shell a distance that no point of the shell is nearer than."""
        squared, error = centre_distances(x, self.centres)
        near = np.sqrt(np.maximum(squared - error[:, None], 0.0))[:, self.cell]
        far = np.sqrt(np.maximum(squared, 0.0) + error[:, None])[:, self.cell]
        return np.maximum(np.maximum(near - self.high, self.low - far), 0.0)

    def first(self, x: np.ndarray, k: int) -> list[list[int]]:
        """Per query the shells with the least distances that hold k points together."""
        order = np.argsort(self.at_least(x), axis=1, kind="stable")
        upto = np.cumsum(self.copies[order], axis=1)
        needed = (upto < min(k, int(self.copies.sum()))).sum(1) + 1
        return [shells[:n].tolist() for shells, n in zip(order, needed, strict=True)]

    def further(self, x: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Per query and shell whether it may hold a point not beyond the squared distance ``within``."""
        reach = np.sqrt(within) * (1 + RELATIVE_SLACK) + 1e-12
        return self.at_least(x) <= reach[:, None]


def fitted_centres(points: DataFrame, n_points: int, cells: int, seed: int = 42) -> np.ndarray:
    """Centres of a k-means fit on at most ``SAMPLE_PER_CELL`` points a cell: those with the smallest hashes."""
    wanted = cells * SAMPLE_PER_CELL
    share = min(1.0, 1.2 * wanted / n_points)
    picked = points.filter(F.pmod(F.xxhash64("x", "label"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).limit(2 * wanted)
    sample = picked.select(array_to_vector("x").alias("x")).coalesce(max(1, wanted // 20_000))
    fit = KMeans(k=cells, featuresCol="x", initMode="random", maxIter=CENTRE_ROUNDS, seed=seed).fit(sample)
    return np.array(fit.clusterCenters())


def indexed(points: DataFrame, n_points: int, shell_rows: int) -> tuple[Index, DataFrame]:
    """The index of ``points`` (``x, label, copies``) and the points with their ``shell``; a table of bounded size each driver-side."""
    cells = min(MOST_CELLS, max(1, n_points // shell_rows))
    centres = fitted_centres(points, n_points, cells) if cells > 1 else np.zeros((1, len(points.first()["x"])))
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("x").to_pandas()) if batch.num_rows else np.zeros((0, centres.shape[1]))
            cell = np.zeros(len(x), np.int64)
            step = max(1, MATRIX_CELLS // len(centres))
            for at in range(0, len(x), step):
                cell[at : at + step] = centre_distances(x[at : at + step], centres)[0].argmin(1)
            distance = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield batch.append_column("cell", pa.array(cell)).append_column("distance", pa.array(distance))

    placed = cut_lineage(points.mapInArrow(assign, "x array<double>, label double, copies bigint, cell bigint, distance double"))
    grid = [i / MOST_SHELLS for i in range(1, MOST_SHELLS)]
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("distance", grid).alias("grid")).collect()
    cuts = {}
    for row in held:
        shells = min(MOST_SHELLS, -(-row["n"] // shell_rows))
        cuts[row["cell"]] = sorted({row["grid"][MOST_SHELLS * s // shells - 1] for s in range(1, shells)})
    cut_rows = [(cell, [float(c) for c in values]) for cell, values in cuts.items()]
    table = points.sparkSession.createDataFrame(cut_rows, "cell bigint, cuts array<double>")
    shell = F.size(F.filter("cuts", lambda cut: cut <= F.col("distance")))
    shelled = placed.join(F.broadcast(table), "cell").select("x", "label", "copies", "cell", "distance", (F.col("cell") * MOST_SHELLS + shell).cast("int").alias("shell"))
    shells = shelled.groupBy("shell", "cell").agg(
        F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("points"), F.sum("copies").alias("copies")
    )
    found = sorted(shells.collect(), key=lambda r: r["shell"])  # at most MOST_CELLS * MOST_SHELLS rows
    number = {r["shell"]: i for i, r in enumerate(found)}
    index = Index(centres, *[np.array([r[c] for r in found]) for c in ("cell", "low", "high", "points", "copies")])
    # Distances were rounded once when the points were placed.
    index.low, index.high = index.low * (1 - 1e-12), index.high * (1 + 1e-12)
    renumbered = points.sparkSession.createDataFrame(list(number.items()), "shell int, block int")
    return index, shelled.join(F.broadcast(renumbered), "shell").select("x", "label", "copies", "block")


# ---- the search --------------------------------------------------------------------------------------------------


VISIT = "qid bigint, x array<double>, within double, block int"


def searched(visits: DataFrame, points: DataFrame, index: Index, k: int, block_rows: int) -> DataFrame:
    """``qid, label, copies, distance``: per visit the nearest points of the block, at most k."""
    spark = visits.sparkSession
    asked = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}  # bounded by the index
    sizes = [(block, -(-int(index.points[block]) // block_rows), -(-n // block_rows)) for block, n in asked.items()]
    table = F.broadcast(spark.createDataFrame(sizes, "block int, pieces int, chunks int"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    right = points.join(table, "block").withColumn("piece", F.pmod(F.xxhash64("x", "label"), F.col("pieces")).cast("int")).withColumn("chunk", every("chunks"))
    left = visits.join(table, "block").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).withColumn("piece", every("pieces"))
    neighbours = block_search(k)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "label": [], "copies": [], "distance": []})
        labels = right["label"].to_numpy()
        q, p, distance = neighbours(np.stack(left["x"]), np.stack(right["x"]), labels, left["within"].to_numpy())
        return pd.DataFrame({"qid": left["qid"].to_numpy()[q], "label": labels[p], "copies": right["copies"].to_numpy()[p], "distance": distance})

    keys = ["block", "piece", "chunk"]
    grouped = left.select(*keys, "qid", "x", "within").groupBy(*keys).cogroup(right.select(*keys, "x", "label", "copies").groupBy(*keys))
    return grouped.applyInPandas(nearest, "qid bigint, label double, copies bigint, distance double")


def in_order(candidates: DataFrame) -> tuple[DataFrame, Column]:
    """Candidates numbered by distance and label within a query, and the copies up to each."""
    order = Window.partitionBy("qid").orderBy("distance", "label")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return candidates.withColumn("place", F.row_number().over(order)).withColumn("upto", upto)


def visits_of(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """First visits: ``queries`` (``qid, x``) with the shells to look into, ``visited``."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX_CELLS // len(index.cell))
        for batch in batches:
            x = np.stack(batch.column("x").to_pandas()) if batch.num_rows else np.zeros((0, index.centres.shape[1]))
            found = [shells for at in range(0, len(x), step) for shells in index.first(x[at : at + step], k)]
            yield batch.append_column("visited", pa.array(found, pa.list_(pa.int32())))

    return queries.mapInArrow(visit, "qid bigint, x array<double>, visited array<int>")


def further_visits(queries: DataFrame, index: Index) -> DataFrame:
    """``queries`` (``qid, x, visited, within``) to one row per other shell that may hold a nearer point."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX_CELLS // len(index.cell))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, within = np.stack(part.column("x").to_pandas()), part.column("within").to_numpy()
                open_ = index.further(x, within)
                for row, visited in enumerate(part.column("visited").to_pylist()):
                    open_[row, visited] = False
                row, block = np.nonzero(open_)
                taken = part.select(["qid", "x", "within"]).take(pa.array(row))
                yield taken.append_column("block", pa.array(block, pa.int32()))

    return queries.select("qid", "x", "visited", "within").mapInArrow(visit, VISIT)


def nearest_points(points: DataFrame, queries: DataFrame, k: int, shell_rows: int = SHELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``qid, label, copies, distance``, a superset of the k nearest of ``points`` (``x, label, copies``) for each of
    ``queries`` (``qid, x``), both written tables without repeated rows."""
    n_points = points.count()
    if n_points == 0:
        return points.sparkSession.createDataFrame([], "qid bigint, label double, copies bigint, distance double")
    index, blocks = indexed(points, n_points, shell_rows)
    first = cut_lineage(visits_of(queries, index, k))
    visits = first.select("qid", "x", F.lit(float("inf")).alias("within"), F.explode("visited").alias("block"))
    found = cut_lineage(searched(visits, blocks, index, k, block_rows))
    if len(index.cell) == 1:
        return found
    # The k-th distance so far: no point beyond it matters. Fewer than k points in all: everything was visited.
    limits = in_order(found).filter(F.col("upto") >= k).groupBy("qid").agg(F.min("distance").alias("within"))
    more = cut_lineage(further_visits(first.join(limits, "qid"), index))
    return found.unionByName(searched(more, blocks, index, k, block_rows))


def predict_knn(
    train: DataFrame,
    test: DataFrame,
    features: str = "features",
    label: str = "label",
    k: int = 5,
    shell_rows: int = SHELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``test`` with ``prediction`` and ``score``: majority among the k nearest training rows (euclidean).

    Neighbours at equal distance count in label order; vote ties go to the smallest label. ``score`` is the share of
    votes for label 1. A prediction depends on the features alone, so equal test rows are answered once.
    """
    points = cut_lineage(
        train.select(as_array(train, features).alias("x"), quoted(label).cast("double").alias("label"))
        .groupBy("x", "label")
        .agg(F.count("*").alias("copies"))
    )
    keyed = test.withColumn("_x", as_array(test, features))
    asked = keyed.groupBy(F.col("_x").alias("x")).agg(F.count("*").alias("n"))
    queries = cut_lineage(asked.withColumn("qid", F.monotonically_increasing_id()))
    candidates = nearest_points(points, queries.select("qid", "x"), k, shell_rows, block_rows)
    votes = (
        in_order(candidates)
        .filter(F.col("place") <= k)
        .withColumn("vote", F.least("copies", F.lit(k) - F.col("upto") + F.col("copies")))
        .filter("vote > 0")
        .groupBy("qid", "label")
        .agg(F.sum("vote").alias("votes"))
    )
    ones = F.sum(F.when(F.col("label") == 1, F.col("votes")).otherwise(F.lit(0)))
    best = votes.groupBy("qid").agg(
        F.max(F.struct("votes", (-F.col("label")).alias("minus"))).alias("top"), (ones / F.sum("votes")).alias("score")
    )
    answered = queries.join(best, "qid").select(F.col("x").alias("_x"), "n", (-F.col("top.minus")).alias("prediction"), "score")
    return lookup(keyed, cut_lineage(answered), ["_x"], "n").drop("_x")
