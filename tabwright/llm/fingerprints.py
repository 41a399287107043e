"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band. Each of ``SUBSETS`` random subsets of it
keeps a share of the terms; a document's terms in the lexicon, distinct and sorted, are hashed within each subset. Dense
subsets match only for near copies, sparse ones also for texts that share part of their terms, so that the share of
equal hashes is a likeness.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The band of document frequencies, as shares of the documents with a term; a term must occur in two documents.
RAREST, COMMONEST = 0.0005, 0.3
#: Each subset keeps one term in so many. Most are sparse: in them two texts match about as often as they share terms.
KEEPS_ONE_IN = (1,) + (4,) * 4 + (16,) * 6 + (64,) * 8 + (256,) * 12 + (1024,) * 24
SUBSETS = len(KEEPS_ONE_IN)
#: Terms that a task counts before it sends its counts on.
COUNTED_AT_ONCE = 400_000
EMPTY = "-" * 8


def terms_of(text: str | None) -> set[int]:
    """Distinct lower-case terms, as 64-bit hashes."""
    return set(map(xxhash.xxh3_64_intdigest, set((text or "").lower().encode("utf-8", "surrogatepass").split())))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> list[int]:
    """Sorted terms within the band, counted over all documents.

    Their number has a bound: a document's mean number of distinct terms divided by ``rarest``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            terms = np.fromiter(counts, np.uint64, len(counts)).view(np.int64)
            batch = pa.record_batch([pa.array(terms), pa.array(list(counts.values()), pa.int32())], ["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text))
                if len(counts) >= COUNTED_AT_ONCE:
                    yield told()
        if counts:
            yield told()

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, n int")
    frequency = partial.groupBy("term").agg(F.sum("n").alias("df"))
    n_docs = docs.count()
    band = frequency.filter((F.col("df") >= max(2, rarest * n_docs)) & (F.col("df") <= max(2, commonest * n_docs)))
    return sorted(r.term % 2**64 for r in band.select("term").toLocalIterator())


class Fingerprinter:
    """Fingerprints of texts over a lexicon; terms are known by their place in it, so places are sorted terms."""

    def __init__(self, terms: list[int]):
        self.places = {term: i for i, term in enumerate(terms)}
        self.hashes = np.array(terms, np.uint64)
        self.member = np.zeros((len(terms), SUBSETS), bool)
        for k, one_in in enumerate(KEEPS_ONE_IN):
            x = (self.hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            self.member[:, k] = (x >> np.uint64(40)) % np.uint64(one_in) == 0

    def __call__(self, text: str | None) -> str:
        """Eight hex digits per subset (dashes: no term in it). A text without any lexicon term: a hash of the text."""
        found = terms_of(text) & self.places.keys()
        at = np.array(sorted(map(self.places.__getitem__, found)), np.int64)
        member = self.member[at]
        if not member.any():
            return "text:" + hashlib.sha1((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        hashes, filled = self.hashes[at], member.any(axis=0)
        parts = [f"{xxhash.xxh3_64_intdigest(hashes[member[:, k]].tobytes()) >> 32:08x}" if filled[k] else EMPTY for k in range(SUBSETS)]
        return "".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets in which either has a term; without such, whether they are equal."""
    if a == b or a.startswith("text:") or b.startswith("text:"):
        return float(a == b)
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 8 * SUBSETS, 8)]
    told = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(told) / len(told)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_sequence(docs: DataFrame, rows_per_bucket: int = 2_000) -> DataFrame:
    """Rows ``_bucket, _tail, doc_id, text``, each bucket sorted by id in one partition and ended by a ``_tail``: the row
    that follows its last one. Buckets are ranges of ids; what follows the last is the first row.

    Only the ranges' bounds reach the driver, a pair of numbers per bucket.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = plain.select("doc_id")
    n = ids.count()
    n_buckets = max(1, min(20_000, n // rows_per_bucket))
    probes = [i / n_buckets for i in range(1, n_buckets)]
    bounds = np.array(sorted(set(ids.approxQuantile("doc_id", probes, 0.2 / n_buckets))) if probes else [], np.float64)

    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(np.float64), "right"))

    bucketed = plain.withColumn("_bucket", F.pandas_udf(bucket, "int")("doc_id"))
    firsts = sorted((r._bucket, r.first) for r in ids.withColumn("_bucket", F.pandas_udf(bucket, "int")("doc_id")).groupBy("_bucket").agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def tail_of(values: pd.Series) -> pd.Series:
        return pd.Series([before.get(v, -1) for v in values], dtype="int32")

    own, other = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("t"))
    both = F.explode(F.when(F.col("_to") >= 0, F.array(own, other)).otherwise(F.array(own)))
    sent = bucketed.withColumn("_to", F.pandas_udf(tail_of, "int")("doc_id")).select(both.alias("_at"), "doc_id", "text")
    sent = sent.select(F.col("_at.b").alias("_bucket"), F.col("_at.t").alias("_tail"), "doc_id", "text")
    return sent.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", "doc_id", F.xxhash64("text"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, terms: list[int] | None = None) -> DataFrame:
    """`RESULT` per row: fingerprints of each text and of its edited text, likeness to that and to the next text.

    Null texts are empty. Rows that repeat an id follow each other. A null id comes first. One row alone is its own
    next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs) if terms is None else terms)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = Fingerprinter(shared.value)
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]
        held = None  # the row whose next one is awaited, with its fingerprint
        for batch in batches:
            out = []
            for bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_tail", "doc_id", "text")), strict=True):
                text = text or ""
                mark = fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, held_id, held_text, held_mark = held
                    changed = edited(held_text, text)
                    changed_mark = fingerprint(changed)
                    out.append((
                        None if held_id == -(1 << 63) else held_id, len(held_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        held_mark, changed_mark, likeness(held_mark, changed_mark), likeness(held_mark, mark),
                    ))
                held = None if tail else (bucket, doc_id, text, mark)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return in_sequence(docs).mapInArrow(walk, RESULT)
