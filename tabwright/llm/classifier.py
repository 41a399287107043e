"""Quality scores by compression.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed in pieces with each; the
difference of the two sizes over their sum says which kind it is like, and a logistic curve fitted to labelled texts
that the dictionaries have not seen makes it a probability.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written

#: Labelled texts taken per label at most, half of them for the dictionaries and half for the curve, in hash order.
SAMPLE_PER_LABEL = 3_000
#: Bytes of labelled text per label that the dictionaries are trained on at most: pieces from all over each text.
TRAINING_BYTES = 16 << 20
DICTIONARY_BYTES = 1 << 18
LEVEL = 3
PIECE = 500


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        """``f(text) -> score``; makes the compressors once."""
        likeness = measure(self.good, self.bad)
        return lambda text: float(1 / (1 + np.exp(-(self.slope * likeness(text) + self.intercept))))


def measure(good: bytes, bad: bytes):
    """``f(text) -> (bad size - good size) / (both)``; 0 for an empty text."""
    compressors = []
    for raw in (good, bad):
        frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if raw:
            frame["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
            frame["dict_data"].precompute_compress(level=LEVEL)
        compressors.append(zstandard.ZstdCompressor(level=LEVEL, **frame))

    def likeness(text: str | None) -> float:
        parts = pieces((text or "").encode("utf-8", "surrogatepass"))
        a, b = (sum(len(c.compress(p)) for p in parts) for c in compressors)
        return (b - a) / max(1, a + b)

    return likeness


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def spread(text: str, most: int) -> list[bytes]:
    """Pieces of a text, evenly spaced over all of it, of at most about ``most`` bytes together."""
    parts = pieces(text.encode("utf-8", "surrogatepass"), 2 * PIECE)
    taken = max(1, most // (2 * PIECE))
    if len(parts) <= taken:
        return parts
    return [parts[int(at)] for at in np.linspace(0, len(parts) - 1, taken)]


def dictionary(samples: list[bytes]) -> bytes:
    total = sum(map(len, samples))
    while total:
        try:  # a small sample can't fill a large dictionary
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            if total > 1 << 24:
                raise
            samples, total = samples * 4, total * 4
    raise ValueError("no labelled text to train on")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps, with a little shrinkage of the slope."""
    spread = x.std() or 1.0
    design, weights = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    shrink = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ weights))
        slope = design.T @ (p - y) + shrink @ weights
        bend = design.T @ (design * (p * (1 - p))[:, None]) + shrink + 1e-9 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / spread), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out: whole texts for the curve, pieces from all over
    them for the dictionaries.

    Labels other than 0 and 1 and null ids are left out; of an id's labels the larger counts, of its texts the smallest. A
    null text is empty. With fewer than two texts of a label there is nothing to tell
    apart: every score is the share of label 1 then, 0.5 without any label.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [known.filter(F.col("quality") == q).orderBy(*order).limit(per_label) for q in (0, 1)]
    # At most 2 * per_label ids: numbered, and broadcast.
    place = F.row_number().over(Window.partitionBy("quality").orderBy(*order))
    chosen = written(taken[0].union(taken[1]).withColumn("place", place))
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(sample.groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text")))
    share = known.agg(F.avg("quality")).first()[0]
    held = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if min(held.get(0, 0), held.get(1, 0)) < 2:
        share = min(max(0.5 if share is None else share, 0.01), 0.99)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    # Places alternate between the dictionaries and the curve.
    halves = sample.withColumn("_half", F.row_number().over(Window.partitionBy("quality").orderBy("place")) % 2)
    most = TRAINING_BYTES // max(held.values())
    cut = F.pandas_udf(lambda texts: pd.Series([spread(t, most) for t in texts], dtype=object), "array<binary>")
    training = halves.filter("_half = 1").select("quality", "place", cut("text").alias("parts")).collect()  # TRAINING_BYTES per label at most
    bad, good = (dictionary([p for r in sorted(training) if r["quality"] == q for p in r["parts"]]) for q in (0, 1))

    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        likeness = measure(good, bad)
        for texts in batches:
            yield pd.Series([likeness(t) for t in texts], dtype="float64")

    points = halves.filter("_half = 0").select("quality", "place", F.pandas_udf(measured, "double")("text").alias("x")).collect()  # per_label numbers
    x = [np.array([r["x"] for r in sorted(points) if r["quality"] == q]) for q in (0, 1)]
    y = np.concatenate([np.zeros(len(x[0])), np.ones(len(x[1]))])
    slope, intercept = curve(np.concatenate(x), y)
    # The sample may hold the labels in other shares than the labelled rows.
    intercept += np.log(share / (1 - share)) - np.log(len(x[1]) / len(x[0]))
    return Model(good, bad, slope, float(intercept))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; null texts score as empty ones."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id").cast("long")), F.lit(False)).alias("held_out"),
        F.pandas_udf(score, "double")(F.col("text").cast("string")).alias("score"),
    )
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
