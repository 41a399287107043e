"""Groups of spelling variants by a trie over letter-group counts.

A word's vector is its length and how often it has a letter of each group. One inserted, deleted or replaced letter adds
at most one to one count and takes at most one from another. Words are arranged in a trie by successive counts; a
depth-first search follows the counts of a word and spends a surplus and a deficit of one each on the way. The words of
the leaves it reaches are compared letter by letter.

The upper part of the trie, whose size is bounded, goes to all tasks and tells each word the buckets to look into. A
bucket of the shuffle is the lower trie of its words; the words that look into it go down together, as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written

LEAST_LETTERS = 6
LEAST_TIMES = 5
#: A form occurs this many times as often as its variant.
FORM_TIMES = 5
#: One word of a document in so many loses a letter; None leaves words as they are.
DROPPED = 199
#: Groups of letters, frequent ones alone; all other letters are the last group.
GROUPS = ("e", "a", "i", "o", "n", "r", "s", "t", "l", "u", "d", "c", "m", "p", "h", "g", "bv", "fw", "ky", "jqxz")
GROUP_OF = {letter: k for k, letters in enumerate(GROUPS) for letter in letters}
OTHERS = len(GROUPS)
LEVELS = len(GROUPS) + 2
#: Letters are code points below 256.
GROUP_CODES = np.array([GROUP_OF.get(chr(c), OTHERS) for c in range(256)])
#: Words of a leaf, and of a bucket at least; with more words altogether buckets are larger, so that the upper trie keeps its bound.
LEAF = 64
BUCKET = 4096
UPPER_NODES = 4_000
#: Letters compared at once, and words that look into a bucket together.
CELLS = 4_000_000
TOGETHER = 20_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: Texts above this are searched match by match rather than as a list.
LONG_TEXT = 1 << 20
#: Lower-case letters A to Z, and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# ---- words -------------------------------------------------------------------------------------------------------


def variants(doc_id: str | None, text: str, dropped: int | None) -> Iterator[tuple[str, int]]:
    """Distinct words of a text with their number; by a checksum of id and word some lose a letter."""
    lowered = text.encode("utf-8", "surrogatepass").lower()  # bytes: A to Z only
    runs = RUN.findall(lowered) if len(lowered) <= LONG_TEXT else (m.group() for m in RUN.finditer(lowered))
    seed = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, times in Counter(runs).items():
        word = run.decode()
        if dropped and (h := zlib.crc32(run, seed)) % dropped == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, times


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, dropped: int | None = DROPPED) -> DataFrame:
    """``word, n``: words of all texts with their number of occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, times in variants(doc_id.as_py(), text.as_py() or "", dropped):
                    if len(word) >= least_letters:
                        held[word] = held.get(word, 0) + times
                if len(held) >= HELD_WORDS:
                    yield flushed()
                    held = {}
        yield flushed()

    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


# ---- the trie ----------------------------------------------------------------------------------------------------


def vector(word: str) -> tuple[int, ...]:
    """Length, then the number of letters of each group."""
    counts = [0] * LEVELS
    counts[0] = len(word)
    for letter in word:
        counts[GROUP_OF.get(letter, OTHERS) + 1] += 1
    return tuple(counts)


def buckets_of(counts: tuple[int, ...], upper: dict) -> Iterator[int]:
    """The buckets that a word's search reaches. Words as long or one letter longer are looked for, so that each pair is
    found from one side; a longer one has one surplus and no deficit."""
    open_ = [(upper, 0, 1, 1)]
    while open_:
        node, level, up, down = open_.pop()
        count = counts[level]
        if level == 0:
            steps = ((count, up, down), (count + 1, up, 0))
        else:
            steps = ((count, up, down), (count + 1, up - 1, down), (count - 1, up, down - 1))
        for to, more, less in steps:
            if more >= 0 and less >= 0 and (child := node.get(to)) is not None:
                if isinstance(child, dict):
                    open_.append((child, level + 1, more, less))
                else:
                    yield child


def home(counts: tuple[int, ...], upper: dict) -> int:
    """The bucket that holds a word."""
    node, level = upper, 0
    while isinstance(node, dict):
        node = node[counts[level]]
        level += 1
    return node


def upper_trie(found: DataFrame, n_words: int) -> dict:
    """Nested counts down to the nodes of at most ``BUCKET`` words (or a bound that grows with ``n_words``), which are numbered.

    Each level has at most ``UPPER_NODES`` inner nodes, so the driver holds a bounded table whatever the number of words.
    """
    most = max(BUCKET, -(-n_words // UPPER_NODES))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, ...], int] = {}
            for word in batch.column(0).to_pylist():
                counts = vector(word)
                for level in range(1, LEVELS + 1):
                    held[counts[:level]] = held.get(counts[:level], 0) + 1
            yield pa.record_batch([pa.array(list(held), pa.list_(pa.int32())), pa.array(list(held.values()), pa.int64())], ["path", "n"])

    counted = found.select("word").mapInArrow(paths, "path array<int>, n long").groupBy("path").agg(F.sum("n").alias("n"))
    is_inner = (F.col("n") > most) & (F.size("path") < LEVELS)
    nodes = written(counted.select("path", is_inner.alias("inner"), F.slice("path", 1, F.size("path") - 1).alias("above")))
    inner = nodes.filter("inner").select(F.col("path").alias("above"))
    children = nodes.join(F.broadcast(inner), "above").select("path", "inner").union(nodes.filter("size(path) = 1").select("path", "inner"))
    trie: dict = {}
    number = 0
    for path, inner in sorted((tuple(r["path"]), r["inner"]) for r in children.collect()):  # a node before those below it
        node = trie
        for count in path[:-1]:
            node = node[count]
        node[path[-1]] = {} if inner else number
        number += not inner
    return trie


# ---- the words of a bucket ---------------------------------------------------------------------------------------


def letters_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def group_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    place = np.repeat(np.arange(n), letters.shape[1]) * (OTHERS + 1) + GROUP_CODES[letters.ravel()]
    return np.bincount(place, minlength=n * (OTHERS + 1)).reshape(n, OTHERS + 1)


def one_edit(short: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``short`` and ``words`` that one replaced letter, or one inserted into ``short``, makes equal."""
    found = []
    step = max(1, CELLS // max(1, words.size))
    for at in range(0, len(short), step):
        part = short[at : at + step]
        if part.shape[1] == words.shape[1]:
            near = np.count_nonzero(part[:, None] != words[None], axis=2) == 1
        else:
            # Equal up to some place, and from there on one letter later.
            ahead, behind = part[:, None] != words[None, :, :-1], part[:, None] != words[None, :, 1:]
            first = np.where(ahead.any(2), ahead.argmax(2), part.shape[1])
            last = np.where(behind.any(2), part.shape[1] - behind[:, :, ::-1].argmax(2), 0)
            near = last <= first
        q, w = np.nonzero(near)
        found.append((q + at, w))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


class Bucket:
    """Words of one length, as the trie below a node."""

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.letters = letters_of(words, self.length)
        self.counts = group_counts(self.letters)

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs ``(of words, of the bucket)`` one edit apart; ``words`` have one length."""
        letters = letters_of(words, len(words[0]))
        counts, everyone = group_counts(letters), np.arange(len(words))
        down = np.full(len(words), int(len(words[0]) == self.length))
        open_ = [(np.arange(len(self.letters)), everyone, 0, np.ones(len(words), np.int64), down)]
        while open_:
            members, asking, group, up, down = open_.pop()
            if len(members) <= LEAF or group > OTHERS:
                q, w = one_edit(letters[asking], self.letters[members])
                if len(q):
                    yield asking[q], members[w]
                continue
            held, asked = self.counts[members, group], counts[asking, group]
            for count in np.unique(held):
                gap = count - asked
                more, less = up - (gap > 0), down - (gap < 0)
                goes = (np.abs(gap) <= 1) & (more >= 0) & (less >= 0)
                if goes.any():
                    open_.append((members[held == count], asking[goes], group + 1, more[goes], less[goes]))


ROUTED = "bucket int, query boolean, word string, n long"
PAIRS = "word string, n long, near string, near_n long"


def batches_of(rows: Iterable[tuple], schema: str, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(zip(*held, strict=True), types, strict=True)], list(names))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def near_pairs(found: DataFrame, partitions: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, once (the shorter, or else smaller, word first)."""
    n_words = found.count()
    spark = found.sparkSession
    upper = spark.sparkContext.broadcast(upper_trie(found, n_words))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts = vector(word)
                    yield home(counts, upper.value), False, word, n
                    for bucket in buckets_of(counts, upper.value):
                        yield bucket, True, word, n

        yield from batches_of(rows(), ROUTED)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(members: list[tuple], bucket: Bucket, asking: list[tuple]) -> Iterator[tuple]:
            for length in {len(word) for word, _ in asking}:
                some = [item for item in asking if len(item[0]) == length]
                for q, w in bucket.near([word for word, _ in some]):
                    for i, j in zip(q.tolist(), w.tolist(), strict=True):
                        if length < bucket.length or some[i][0] < members[j][0]:
                            yield *some[i], *members[j]

        def rows() -> Iterator[tuple]:
            here, members, bucket, asking = None, [], None, []
            for batch in batches:
                for number, query, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if number != here or len(asking) == TOGETHER:
                        if members and asking:
                            bucket = bucket or Bucket([w for w, _ in members])
                            yield from pairs(members, bucket, asking)
                        asking = []
                    if number != here:
                        here, members, bucket = number, [], None
                    (asking if query else members).append((word, n))
            if members and asking:
                yield from pairs(members, bucket or Bucket([w for w, _ in members]), asking)

        yield from batches_of(rows(), PAIRS)

    parts = partitions or max(1, min(n_words // 500, 20_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = found.select("word", "n").mapInArrow(routed, ROUTED).repartition(parts, "bucket")
    return buckets.sortWithinPartitions("bucket", "query").mapInArrow(compared, PAIRS)


# ---- forms and roots ---------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms`` (``word, form``): the end of the chain of forms.

    Paths double in each round. A form occurs several times as often as its variant, so chains are short.
    """
    known = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = known.join(onward, "root")
        if further.isEmpty():
            return known
        known = written(known.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))


def spelling_groups(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, form_times: int = FORM_TIMES, dropped: int | None = DROPPED
) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` per word of all texts that is long and frequent enough.

    Words are runs of letters (A to Z in lower case). Near words are one inserted, deleted or replaced letter apart; the
    form is the most frequent one (ties: the smallest) if it occurs ``form_times`` as often, the root is where following
    forms ends. ``dropped`` sets how many words of documents lose a letter first. Null and empty texts have no words;
    repeated rows count each; a null id counts as empty. No words give no rows. Further columns are ignored.
    """
    found = written(words(docs, least_letters, least_times, dropped))
    pairs = written(near_pairs(found))
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    told = found.join(near, "word", "left")
    has_form = -F.col("_best.less") >= F.col("n") * form_times
    told = written(told.select(
        "word", "n", F.when(has_form, F.col("_best.form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("_best.less")).alias("form_n"),
    ))
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
