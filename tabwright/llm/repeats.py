"""Substring deduplication by seed and extend.

Of each window of ``LEAST`` consecutive words the smallest hash of ``ANCHOR`` consecutive words is its anchor (winnowing),
so equal windows have equal anchors. Seeds are anchors that occur more than once; each occurrence is extended both ways
to the windows it is the anchor of, and those are matched by their full content. A window whose words also start
earlier is a repeat; unions of such windows are the maximal repeats.

Tasks first settle what repeats within their own block of text and send on only the first occurrence of an anchor or
window, so that a passage in most documents reaches the shuffle once a block and not once a document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 20
ANCHOR = 8
#: Words a task holds at once: a few arrays of this length.
BLOCK_WORDS = 1_000_000
#: Windows are compared in as many buckets as there are so many bytes of text.
BUCKET_BYTES = 1 << 24
NO_ID = -(1 << 63)
SPAN = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
U = np.uint64


#: Hashes of so many words are kept: most words are rare, and looking them up again costs more than hashing them.
KEPT_WORDS = 1 << 16


class WordHashes(dict):
    """Hashes of words; the common ones are kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def runs(coded: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of each run of ``length`` values, joined from runs of powers of two."""
    power, step, found, done = coded, U(factor), None, 0
    for bit in range(length.bit_length()):
        size = 1 << bit
        if length & size:
            part = power
            if found is None:
                found = part
            else:
                n = len(coded) - done - size + 1
                found = scrambled(found[:n] * step) + part[done : done + n]
            done += size
        if length >> (bit + 1):
            power = scrambled(power[: len(power) - size] * step) + power[size:]
    return scrambled(found[: max(0, len(coded) - length + 1)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors_of_windows(coded: np.ndarray) -> np.ndarray:
    """The place of each window's anchor: the smallest, of equal ones the last."""
    reach = LEAST - ANCHOR + 1
    hashed = runs(coded, ANCHOR, 0x9E3779B97F4A7C15)
    backwards = sliding_window_view(hashed, reach)[:, ::-1]
    return np.arange(len(backwards)) + reach - 1 - backwards.argmin(axis=1)


class Block:
    """Occurrences that a task has gathered: hashes, place in the block's list of documents, position."""

    def __init__(self) -> None:
        self.parts, self.rows, self.size = [], [], 0

    def add(self, row: tuple, position: np.ndarray, *hashes: np.ndarray) -> None:
        self.parts.append((np.full(len(position), len(self.rows), np.int64), position, *hashes))
        self.rows.append(row[:2])
        self.size += len(position)

    def settled(self) -> tuple[np.ndarray, ...]:
        """Place of the document, position, hashes, and which occurrences are the first of their hashes, later ones, and
        first ones with a later one; in the order of the text. Empties the block."""
        at, position, *hashes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rows, self.parts, self.rows, self.size = self.rows, [], [], 0  # the parts go before the arrays are sorted
        ids = np.array([r[0] for r in rows], np.int64)[at]
        found = (at, position, hashes, *first_and_later(hashes, ids, position), rows)
        return found


def first_and_later(hashes: list[np.ndarray], ids: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((position, ids, *hashes))
    d, p = ids[order], position[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        new[1:] |= np.diff(h[order]) != 0
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (d != d[start]) | (p != p[start])
    repeated = np.zeros(len(order), bool)
    repeated[start[later]] = True
    found = [np.empty(len(order), bool) for _ in range(3)]
    for marks, values in zip(found, (new, later, repeated), strict=True):
        marks[order] = values
    return tuple(found)


SEED = "hash long, _id long, _text long, position int, known boolean"


def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each document. The first occurrence in a block is sent with its hash, to be compared with other blocks;
    later ones are known to repeat, and so is the first then."""
    hashes, block = WordHashes(), Block()

    def told() -> pa.RecordBatch:
        at, position, (hashed,), first, later, several, rows = block.settled()
        sent = first | later
        ids, texts = (np.array([r[k] for r in rows], np.int64)[at[sent]] for k in (0, 1))
        keys = pa.array(hashed[sent].view(np.int64), mask=later[sent])
        arrays = [keys, pa.array(ids), pa.array(texts), pa.array(position[sent].astype(np.int32)), pa.array((later | several)[sent])]
        return pa.record_batch(arrays, [c.split()[0] for c in SEED.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "text")), strict=True):
            words = words_of(row[2])
            if len(words) < LEAST:
                continue
            coded = np.fromiter(map(hashes.__getitem__, words), U, len(words))
            places = np.unique(anchors_of_windows(coded))
            block.add(row, places, runs(coded, ANCHOR, 0x9E3779B97F4A7C15)[places])
            if block.size >= BLOCK_WORDS // 4:
                yield told()
    if block.size:
        yield told()


#: Windows of a block and bucket as arrays of bytes: two hashes each (none if they are known to repeat), and per document
#: its id, a hash of its text, the number of its entries and these: positions, or runs of known ones.
PACKED = "bucket int, one binary, two binary, ids binary, texts binary, counts binary, places binary"
#: A run of window starts as one number: the first in the high bits, how many in the low ones.
RUN_BITS = 31


def packed(bucket: int, at: np.ndarray, places: np.ndarray, rows: np.ndarray, one=None, two=None) -> tuple:
    """``at`` (places in ``rows``) is in ascending order."""
    docs, counts = np.unique(at, return_counts=True)
    parts = (rows[docs, 0], rows[docs, 1], counts.astype(np.int32), places)
    return (bucket, None if one is None else one.tobytes(), None if two is None else two.tobytes(), *(x.tobytes() for x in parts))


def extended(n_buckets: int):
    """Windows around the seeds (``places``) of each document, by two hashes of their words, packed by bucket."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), Block()

        def told() -> pa.RecordBatch:
            at, position, (one, two), first, later, _, rows = block.settled()
            rows, out = np.array(rows, np.int64).reshape(-1, 2), []
            bucket = (one % U(n_buckets)).astype(np.int64)
            sent = np.flatnonzero(first)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            for part in np.split(sent, np.flatnonzero(np.diff(bucket[sent])) + 1):
                if len(part):
                    short = (two[part] >> U(32)).astype(np.uint32)
                    out.append(packed(int(bucket[part[0]]), at[part], position[part].astype(np.int32), rows, one[part], short))
            known = np.flatnonzero(later)
            if len(known):
                breaks = (np.diff(known) > 1) | (np.diff(at[known]) != 0) | (np.diff(position[known]) != 1)
                begins = np.append(0, np.flatnonzero(breaks) + 1)
                run = position[known[begins]] << RUN_BITS | np.diff(np.append(begins, len(known)))
                out.append(packed(int(at[known[0]] + len(known)) % n_buckets, at[known[begins]], run, rows))
            kinds = (pa.int32(), *[pa.binary()] * 6)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "text", "places")), strict=True):
                if not row[3]:
                    continue
                words = words_of(row[2])
                coded = np.fromiter(map(hashes.__getitem__, words), U, len(words))
                position = np.flatnonzero(np.isin(anchors_of_windows(coded), row[3]))
                one, two = runs(coded, LEAST, 0xD6E8FEB86659FD93), runs(coded, LEAST, 0xA0761D6478BD642F)
                block.add(row, position, one[position], two[position])
                if block.size >= BLOCK_WORDS:
                    yield told()
        if block.size:
            yield told()

    return extend


def compared(table: pa.Table) -> pa.Table:
    """``_id, _text, runs`` of the repeated windows of one bucket: a bounded share of the windows, as a window comes once a
    block at most and buckets are many."""
    ids, texts, all_runs, firsts = [], [], [], []
    for row in table.to_pylist():
        docs = [np.frombuffer(row[c], np.int64) for c in ("ids", "texts")]
        counts = np.frombuffer(row["counts"], np.int32)
        if row["one"] is None:
            places = np.split(np.frombuffer(row["places"], np.int64), np.cumsum(counts)[:-1])
            ids += docs[0].tolist()
            texts += docs[1].tolist()
            all_runs += places
        else:
            hashes = np.frombuffer(row["one"], U), np.frombuffer(row["two"], np.uint32)
            firsts.append((*hashes, *(np.repeat(x, counts) for x in docs), np.frombuffer(row["places"], np.int32).astype(np.int64)))
    if firsts:
        one, two, doc, text, position = (np.concatenate(x) for x in zip(*firsts, strict=True))
        _, later, _ = first_and_later([one, two], doc, position)
        doc, text, position = doc[later], text[later], position[later]
        order = np.lexsort((position, text, doc))
        doc, text, run = doc[order], text[order], position[order] << RUN_BITS | 1
        ends = np.flatnonzero((np.diff(doc) != 0) | (np.diff(text) != 0)) + 1
        if len(doc):
            begins = np.append(0, ends)
            ids += doc[begins].tolist()
            texts += text[begins].tolist()
            all_runs += np.split(run, ends)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip((ids, texts, all_runs), kinds, strict=True)], names=["_id", "_text", "runs"])


def covered(n_words: int, starts: list[int] | None) -> np.ndarray:
    """Which words lie in a window that starts within one of the runs."""
    marks = np.zeros(n_words + 1, np.int64)
    if starts:
        run = np.asarray(starts, np.int64)
        at = run >> RUN_BITS
        np.add.at(marks, at, 1)
        np.add.at(marks, at + (run & ((1 << RUN_BITS) - 1)) + LEAST - 1, -1)
    return np.cumsum(marks)[:n_words] > 0


def without(text: str | None, starts: list[int] | None) -> str | None:
    """The text without its repeats; white space before a removed word goes with it."""
    if not starts:
        return text
    raw, kept, end = text.encode("utf-8", "surrogatepass"), [], 0
    spans = [m.span() for m in SPAN.finditer(raw)]
    for (_, stop), gone in zip(spans, covered(len(spans), starts), strict=True):
        if not gone:
            kept.append(raw[end:stop])
        end = stop
    return b"".join(kept).lstrip(b" \t\n\x0b\x0c\r").decode("utf-8", "surrogatepass")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``_row`` and its text, under an id and a hash of the text that are never null."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"),
        text.alias("text"), F.struct("*").alias("_row"),
    )


def repeats(rows: DataFrame) -> DataFrame:
    """``_id, _text, starts``: runs of places where repeated windows start, per document with any."""
    hashed = rows.select("_id", "_text", "text")
    key = F.coalesce(F.col("hash"), F.xxhash64("_id", "position", F.lit(7)))  # what has no hash goes anywhere
    several = F.count("*").over(Window.partitionBy(key))
    seeded = hashed.mapInArrow(seeds, SEED).withColumn("_n", several).filter("known OR _n > 1 AND hash IS NOT NULL")
    places = seeded.groupBy("_id", "_text").agg(F.collect_set("position").alias("places"))
    joined = hashed.join(places, ["_id", "_text"], "left")
    n_buckets = max(64, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    windows = joined.mapInArrow(extended(n_buckets), PACKED)
    repeated = windows.groupBy("bucket").applyInArrow(compared, "_id long, _text long, runs array<long>")
    return repeated.groupBy("_id", "_text").agg(F.flatten(F.collect_list("runs")).alias("starts"))


def removed(docs: DataFrame) -> DataFrame:
    """Per row ``_row, doc_id, n_words, n_removed, kept_sha256`` and ``starts`` of its repeated windows.

    Null and empty texts have no words. Rows that repeat an id and a text are one document listed twice: neither is
    earlier. A null id is the smallest. An empty table gives no rows. Texts are shuffled once, by id, for both joins.
    """
    rows = keyed_rows(docs)

    def digest(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        found = []
        for text, at in zip(texts, starts, strict=True):
            words = words_of(text)
            gone = covered(len(words), None if at is None else list(at))
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
            found.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(found, columns=["n_words", "n_removed", "kept_sha256"])

    marked = rows.select("_id", "_text", "text").join(repeats(rows), ["_id", "_text"], "left")
    told = F.pandas_udf(digest, "n_words long, n_removed long, kept_sha256 string")("text", "starts")
    return marked.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), told.alias("_d"), "starts").select("doc_id", "_d.*", "starts")


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words``: the maximal repeats of each document."""
    runs_ = removed(docs).filter("n_removed > 0").select("doc_id", F.explode("starts").alias("_r"))
    at = F.shiftright("_r", RUN_BITS)
    runs_ = runs_.select("doc_id", at.alias("at"), (at + F.col("_r").bitwiseAND((1 << RUN_BITS) - 1) + LEAST - 1).alias("end"))
    ordered = Window.partitionBy("doc_id").orderBy("at", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    parts = runs_.withColumn("_new", F.coalesce(F.col("at") > reached, F.lit(True)).cast("long"))
    numbered = parts.withColumn("_run", F.sum("_new").over(ordered)).groupBy("doc_id", "_run")
    return numbered.agg(F.min("at").alias("first_word"), (F.max("end") - F.min("at")).alias("n_words")).drop("_run")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, their texts without repeats (``n_chars`` follows); documents left without a word go.

    Documents that had no word before stay as they are.
    """
    rows = keyed_rows(docs)

    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([without(t, None if at is None else list(at)) for t, at in zip(texts, starts, strict=True)], dtype=object)

    found = rows.join(repeats(rows), ["_id", "_text"], "left").select("_row", "text", "starts")
    left = found.withColumn("_left", F.pandas_udf(cut, "string")("text", "starts"))
    left = left.filter(F.col("starts").isNull() | (F.length("_left") > 0))
    row = F.col("_row").withField("text", F.col("_left"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("starts").isNull(), F.col("_row.n_chars")).otherwise(F.length("_left").cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", n_chars)
    return left.select(row.alias("_row")).select("_row.*")
