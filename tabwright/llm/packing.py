"""Packing token pieces into sequences by cutting-stock column generation.

Documents are tokenized and cut at multiples of the capacity, so only one remainder a document is shorter. The
histogram of the lengths (at most ``capacity / UNIT`` counts, whatever the corpus) goes to the driver. There a linear
program over patterns is solved by column generation: a knapsack dynamic program prices new patterns from the dual
values. Patterns are rounded down; what is left over fits in at most a few thousand sequences, which are filled one by
one by an exact subset-sum program. Spark then ranks the pieces of each length and hands each its place.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import ranked, written

CAPACITY = 1024
END_ID = 0
#: Lengths are rounded up to multiples of this in the linear program; the true ones decide the offsets.
UNIT = 4
#: The linear program ends when it is this close to its lower bound.
GAP = 1e-3
SMOOTHING = 0.9
#: tiktoken's pattern overflows its stack within about a million white-space characters in a row; longer runs than this go around it.
LONG_RUN = 100_000
#: What the pattern takes as white space.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None):
    """``f(text) -> ids`` of a byte-level BPE in rank format, with the special tokens of the ``tokenizers`` file beside it.

    The rank file of a vocabulary gives the ids of its ``tokenizers`` file (the tests compare them) at four times
    the speed. A text is cut at special tokens, and a long white-space run is one piece of the pattern without its
    last character, which belongs to what follows.
    """
    import public_tokenizers
    import tiktoken

    file = Path(path or default_tokenizer())
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {token["content"]: token["id"] for token in json.loads(file.with_suffix(".json").read_text("utf-8"))["added_tokens"]}
    parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    run = re.compile(f"(?<!{WHITE}){WHITE}{{{LONG_RUN + 1},}}")
    ordinary = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cache
    def whole():
        return tiktoken.Encoding("run", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(text: str) -> list[int]:
        if len(text) <= LONG_RUN:
            return ordinary(text)
        ids, at = [], 0
        for found in run.finditer(text):
            end = found.end() - (found.end() < len(text))
            ids += ordinary(text[at : found.start()])
            ids += whole()(text[found.start() : end])
            at = end
        return ids + ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if parts is None or not any(token in text for token in special):
            return plain(text)
        ids = []
        for part in parts.split(text):
            ids += [special[part]] if part in special else plain(part)
        return ids

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``. A null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids_of, starts, lengths, crcs, totals = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    ids_of.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            yield pa.record_batch(
                [pa.array(x, pa.int64()) for x in (ids_of, starts, lengths, crcs, totals)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# ---- the cutting-stock problem, on a histogram of at most `capacity` lengths ------------------------------------


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of any multiset of lengths within the capacity, and how often it takes each length."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    values, by_length = values[order], lengths[order]
    fitting = np.searchsorted(by_length, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            gained = values[:k] + best[room - by_length[:k]]
            at = int(gained.argmax())
            if gained[at] > best[room] + 1e-12:
                best[room], last[room] = gained[at], at
    taken, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[order[last[room]]] += 1
            room -= by_length[last[room]]
    return float(best[capacity]), taken


def relaxed(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """Near-optimal fractional patterns ``(how often, copies per length)``: revised simplex, columns priced by `knapsack`.

    Dual values swing widely from pivot to pivot, so patterns are priced with values smoothed towards those of the best
    bound so far. When such a pattern doesn't improve the master problem, smoothing is lessened.
    """
    m = len(lengths)
    columns = [np.where(np.arange(m) == i, capacity // lengths, 0) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // lengths))
    used = inverse @ demand
    centre, bound, smoothing = lengths / capacity, 0.0, SMOOTHING
    for _ in range(100 * m):  # far beyond any run seen; what a stop here leaves unfinished, `plan` still places
        dual = inverse.sum(axis=0)
        priced = smoothing * centre + (1 - smoothing) * dual
        value, pattern = knapsack(priced, lengths, capacity)
        if priced @ demand / max(1, value) > bound:
            bound, centre = priced @ demand / max(1, value), priced / max(1, value)
        if used.sum() <= bound * (1 + GAP) or (smoothing == 0 and value <= 1 + 1e-7):
            break
        if dual @ pattern <= 1 + 1e-9:
            smoothing = max(0.0, round(smoothing - 0.1, 1))
            continue
        smoothing = SMOOTHING
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        pivot = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, pivot)
        inverse[leaves] = pivot
        columns[leaves] = pattern
        used = np.maximum(inverse @ demand, 0)
    return list(zip(used, columns, strict=True))


def fullest(room: int, left: dict[int, int]) -> list[int]:
    """Lengths from ``left`` (length to count) with the largest total within ``room``: subset sums as bits of a number."""
    mask, sums = (1 << (room + 1)) - 1, [1]
    usable = sorted((x for x in left if left[x] and x <= room), reverse=True)
    for length in usable:
        now = step = sums[-1]
        for _ in range(min(left[length], room // length)):
            step = step << length & mask
            now |= step
        sums.append(now)
    total, chosen = sums[-1].bit_length() - 1, []
    for before, length in zip(sums[-2::-1], usable[::-1], strict=True):
        while not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Whole patterns ``(how many sequences, {length: copies})`` that hold exactly the lengths of the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    patterns = []
    if capacity in left:
        patterns.append((left.pop(capacity), {capacity: 1}))
    if left:
        lengths = np.array(sorted(left, reverse=True))
        demand = np.array([left[x] for x in lengths], float)
        for times, pattern in relaxed(lengths, demand, capacity):
            copies = {int(x): int(n) for x, n in zip(lengths, pattern, strict=True) if n}
            whole = min([int(times + 1e-9), *(left[x] // n for x, n in copies.items())])
            if whole:
                patterns.append((whole, copies))
                for x, n in copies.items():
                    left[x] -= whole * n
    while any(left.values()):
        first = max(x for x, n in left.items() if n)
        left[first] -= 1
        copies = {first: 1}
        for x in fullest(capacity - first, left):
            copies[x] = copies.get(x, 0) + 1
            left[x] -= 1
        patterns.append((1, copies))
    return patterns


def segments(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, copies, offset``: which ranks of a length each pattern takes."""
    rows, next_rank, sequence = [], {}, 0
    for times, copies in patterns:
        offset = 0
        for length, n in copies.items():
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, n, offset))
            next_rank[length] = rank + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every id of every document in one sequence: a row per piece with ``sequence_id`` and ``offset``.

    Empty and null texts are the end id alone. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    cut = written(pieces(docs, capacity, tokenizer).withColumn("units", F.ceil(F.col("length") / UNIT)))
    histogram = {r.units: r.n for r in cut.groupBy("units").agg(F.count("*").alias("n")).collect()}
    rows = segments(plan(histogram, capacity // UNIT))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 50  # more than the ranks of one length
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            units, rank = batch.column("units").to_numpy(), batch.column("rank").to_numpy()
            _, first, sequence, copies, offset = rows[np.searchsorted(keys, units * span + rank, "right") - 1].T
            nth, slot = np.divmod(rank - first, copies)
            placed = {"sequence_id": pa.array(sequence + nth), "_slot": pa.array(offset + slot * units)}
            kept = {name: batch.column(name) for name in columns}
            yield pa.RecordBatch.from_pydict(kept | placed)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    in_rank = ranked(cut, ["units"], ["doc_id", "start"], "rank", sum(histogram.values()))
    result = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "_slot"])
    placed = in_rank.select(*columns, "units", "rank").mapInArrow(place, result)
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select(*columns, "sequence_id", offset.alias("offset"))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, ids and padding ids. A sequence is padded to the capacity, except where its length is a power of two."""
    total = F.col("ids")
    power = F.bit_count(total) == 1
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    return filled.agg(
        F.count("*").alias("sequences"), F.sum("ids").alias("ids"),
        F.sum(F.when(power, 0).otherwise(capacity - total)).alias("padding"),
    )
