"""Token counts without token ids: pieces per distinct pre-token, times the pre-tokens of each document.

A BPE merge only joins characters that stand next to each other in some piece of the vocabulary. Where a text has two
neighbours that no piece has, it falls into parts that are encoded independently of each other: the pre-tokens. They are
cut by one table lookup per character. Each distinct pre-token of the corpus is encoded once; documents are joined to the
numbers of pieces by their pre-token frequencies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written

LIMIT = 4096
SPACE = "▁"
#: A batch is cut into slices of about this many characters, so that its frequencies are never held as a whole.
SLICE_CHARS = 4_000_000
#: Pre-tokens are broadcast, most frequent first, up to this many bytes; the rest is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
ROW_BYTES = 64
FREQUENCIES = "_row long, doc_id long, n_bytes long, pre array<string>, times array<long>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Cutter:
    """Cuts normalised text into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        apart = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = [model.id_to_piece(i) for i in apart]
        known = sorted({c for piece in pieces for c in piece})
        self.code = np.zeros(max(map(ord, known)) + 2, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.meets = np.zeros((len(known) + 1, len(known) + 1), bool)
        for piece in pieces:
            at = self.code[[ord(c) for c in piece]]
            self.meets[at[:-1], at[1:]] = True
        # A character of no piece: nothing merges with it, so it keeps what follows from the start of a text.
        self.guard = next(chr(c) for c in (*range(1, 32), *range(0xE000, 0xF8FF)) if c >= len(self.code) or not self.code[c])
        self.guarded = len(model.encode(self.guard))

    def pre_tokens(self, text: str) -> list[str]:
        """``text`` as the model normalises it (identity but for the space mark), cut where no piece can lie."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[np.minimum(points, len(self.code) - 1)]
        ends = (np.flatnonzero(~self.meets[code[:-1], code[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]

    def n_pieces(self, pre: str) -> int:
        return len(self.model.encode(self.guard + pre)) - self.guarded


@cache
def cutter(path: str) -> Cutter:
    return Cutter(path)


def frequencies(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row its number, ``doc_id``, the bytes of its text, its distinct pre-tokens and how often it has each."""
    path = model or default_model()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in FREQUENCIES.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path).pre_tokens
        for batch in batches:
            rows, chars = [], 0
            for number, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py() or ""
                found = Counter(cut(text))
                rows.append((number.as_py(), doc_id.as_py(), len(text.encode("utf-8", "surrogatepass")), list(found), list(found.values())))
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, chars = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    plain = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(count, FREQUENCIES)


def pieces(distinct: DataFrame, model: str | None = None) -> DataFrame:
    """``distinct`` (``pre, held``) with ``n_pieces``; each pre-token is encoded here and nowhere else."""
    path = model or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_pieces = cutter(path).n_pieces
        for batch in batches:
            yield batch.append_column("n_pieces", pa.array([n_pieces(p) for p in batch.column("pre").to_pylist()], pa.int64()))

    return distinct.select("pre", "held").mapInArrow(encode, "pre string, held long, n_pieces long")


def frequent_from(table: DataFrame, limit: int) -> int:
    """The least power of two such that the pre-tokens held by as many rows or more fit ``limit`` bytes together."""
    level = F.floor(F.log2("held")).cast("int")
    width = F.octet_length("pre") + ROW_BYTES
    levels = table.groupBy(level.alias("level")).agg(F.sum(width).alias("bytes")).collect()  # at most 64 rows
    total, least = 0, 1 << 62
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > limit:
            break
        least = 1 << row["level"]
    return least


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``: the number of tokens the model gives the whole text.

    A null or empty text has none. Repeated rows, also with one ``doc_id``, are counted each. An empty table gives no
    rows; further columns are ignored. A text without any place to cut is one pre-token.

    Pre-tokens that many documents have are joined by broadcast, up to ``broadcast_bytes`` of them; those left for the
    shuffle are each held by few documents.
    """
    counted = written(frequencies(docs, model))
    held = counted.select("_row", F.explode(F.arrays_zip("pre", "times")).alias("_p")).select("_row", "_p.pre", "_p.times")
    table = written(pieces(held.groupBy("pre").agg(F.count("*").alias("held")), model))
    least = frequent_from(table, broadcast_bytes)
    frequent = table.filter(F.col("held") >= least).select("pre", "n_pieces")
    rare = table.filter(F.col("held") < least).select("pre", F.col("n_pieces").alias("_rare"))
    found = held.join(F.broadcast(frequent), "pre", "left")
    sums = [found.filter("n_pieces IS NOT NULL").groupBy("_row").agg(F.sum(F.col("times") * F.col("n_pieces")).alias("n"))]
    if not rare.isEmpty():
        left = found.filter("n_pieces IS NULL").select("pre", "_row", "times").join(rare, "pre")
        sums.append(left.groupBy("_row").agg(F.sum(F.col("times") * F.col("_rare")).alias("n")))
    totals = sums[0].union(sums[1]).groupBy("_row").agg(F.sum("n").alias("n")) if len(sums) > 1 else sums[0]
    whole = counted.select("_row", "doc_id", "n_bytes").join(totals, "_row", "left")
    n_tokens = F.coalesce("n", F.lit(0)).cast("long")
    return whole.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
