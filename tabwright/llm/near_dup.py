"""Near-duplicate groups by SetSketch registers.

Each text's set of word shingles gets a SetSketch: per register the smallest of exponentially distributed hash values,
rounded to a power of a base near 1 and cut off at both ends. Registers of a union are the larger ones of both sets, and
two sets share a register about as often as they share members. Bands of equal registers give candidates; for each pair
of candidates the registers that are larger, smaller and equal give the most likely similarity; pairs that may reach the
threshold are settled on the full sets.

Texts with equal sets are one class from the start, whatever their number. Within a bucket of a band, classes are first
compared with a leader; only classes that are still in different components are compared with each other. How many of
its members a set has to itself bounds its similarity to any other, and how many are rare bounds it to any set that has
none of these; so the many sets of a large group that are like none of the others are not compared with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written

SHINGLE = 5
THRESHOLD = 80  # per cent
BANDS, ROWS = 32, 4  # a pair at the threshold is missed by all bands with a probability of 5e-8
REGISTERS = BANDS * ROWS
BASE = 1.001
TOP = 65_535
#: Pairs whose likelihood is greatest below this similarity are not compared in full: 5 standard errors from 0.8.
LEAST_LIKELY = 0.6
BROADCAST_IDS = 1_000_000
BLOCK_BYTES = 1 << 24
#: A member that at most so many sets have is rare.
RARE = 64
_RANDOM = np.random.default_rng(20_240_101)
MULTIPLIERS = _RANDOM.integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Hashes of so many words are kept: most words are rare, and looking them up again costs more than hashing them.
KEPT_WORDS = 1 << 16
#: Texts that are Python strings at a time.
TEXTS_AT_A_TIME = 256


class WordHashes(dict):
    """Hashes of words; the common ones are kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    coded = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(coded))
    n = len(coded) - size + 1
    rolled = np.full(n, size, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + coded[k : k + n]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(mixed(rolled))


def registers(members: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set: floor(1 - log_base(smallest exponential value)), between 0 and TOP."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 4096):
        block = members[None, at : at + 4096]
        for j in range(0, REGISTERS, 16):
            hashed = (block ^ MASKS[j : j + 16, None]) * MULTIPLIERS[j : j + 16, None]
            np.minimum(least[j : j + 16], hashed.min(axis=1), out=least[j : j + 16])
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-52))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows of ``a`` and ``b``) of sets of the given sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = share(u - v * grid), share(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(p), 0.0) for n, p in ((more, up), (less, down), (a.shape[1] - more - less, 1 - up - down))]
    best = np.nan_to_num(sum(parts), nan=-np.inf).argmax(axis=1)
    return grid[np.arange(len(a)), best]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``TEXTS_AT_A_TIME`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_A_TIME):
            yield batch.slice(at, TEXTS_AT_A_TIME)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch`` per row; no digest for a text without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            counts, digests, sketches = [], [], []
            for text in part.column("text").to_pylist():
                members = shingle_set(text, size, hashes)
                counts.append(len(members))
                digests.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                sketches.append(registers(members).tobytes() if len(members) else None)
            arrays = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.record_batch(arrays, ["doc_id", "n_shingles", "digest", "sketch"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """``key, id``: a row per class and band."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(len(ids), BANDS, ROWS)
            whole = np.ascontiguousarray(sketches).view("<u8").reshape(len(ids), BANDS)
            band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
            key = mixed(mixed(whole) ^ band[None, :]).view(np.int64)
            yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "id"])

    return classes.select("id", "sketch").mapInArrow(keys, "key long, id long")


def possible(n_a: Column, shared_a: Column, n_b: Column, shared_b: Column, threshold: int) -> Column:
    """Whether two sets may be alike, when at most ``shared`` of their members are in any other set."""
    most = F.least(shared_a, shared_b)
    return (most * (100 + threshold) >= (n_a + n_b) * threshold) & (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * threshold)


def rare_members(sets: DataFrame) -> DataFrame:
    """``member, id, sets``: the members that at most ``RARE`` sets have, a row for each of these sets.

    A task counts within its own sets first and sends a member that too many of them have once, without an id.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list) -> pa.RecordBatch:
            members = np.concatenate([np.frombuffer(m, np.uint64) for _, m in parts])
            ids = np.repeat(np.array([i for i, _ in parts], np.int64), [len(m) // 8 for _, m in parts])
            order = np.argsort(members, kind="stable")
            members, ids = members[order], ids[order]
            first = np.flatnonzero(np.append(True, members[1:] != members[:-1])[: len(members)])  # in order already: no second sort
            counts = np.diff(np.append(first, len(members)))
            held = np.repeat(counts, counts)
            sent = held <= RARE
            sent[first] = True
            n = np.where(held <= RARE, 1, held)
            return pa.record_batch([pa.array(members[sent].view(np.int64)), pa.array(ids[sent], mask=(held > RARE)[sent]), pa.array(n[sent])], ["member", "id", "n"])

        parts, size = [], 0
        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist(), strict=True):
                parts.append(row)
                size += len(row[1])
                if size >= BLOCK_BYTES:
                    yield told(parts)
                    parts, size = [], 0
        if parts:
            yield told(parts)

    sent = sets.select("id", "members").mapInArrow(send, "member long, id long, n long")
    counted = sent.withColumn("sets", F.sum("n").over(Window.partitionBy("member")))
    return counted.filter((F.col("sets") <= RARE) & F.col("id").isNotNull()).select("member", "id", "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of ``a, b`` those with 100 * intersection >= threshold * union; first judged by their sketches."""

    def likely(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        sketches = [np.frombuffer(b"".join(x), "<u2").reshape(-1, REGISTERS) for x in (a, b)]
        return pd.Series(likely_similarity(*sketches, n_a.to_numpy(float), n_b.to_numpy(float)) >= LEAST_LIKELY)

    def settled(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * both >= threshold * (len(x) + len(y) - both))
        return pd.Series(found, dtype=bool)

    small = classes.select("id", "n", "sketch")
    named = pairs.join(small.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    named = named.join(small.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    named = named.filter(F.pandas_udf(likely, "boolean")("n_a", "n_b", "s_a", "s_b")).select("a", "b")
    full = named.join(sets.select(F.col("id").alias("a"), F.col("members").alias("m_a")), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("members").alias("m_b")), "b")
    return written(full.filter(F.pandas_udf(settled, "boolean")("m_a", "m_b")).select("a", "b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (``id, component``) with the components merged that the links join: the smallest id of each.

    Each round joins every component to its smallest neighbour and shortens the paths; links within a component go.
    """
    left = links.join(nodes.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
    left = left.join(nodes.select(F.col("id").alias("b"), F.col("component").alias("y")), "b").filter("x <> y")
    left = written(left.select("x", "y").distinct())
    moved = None
    while not left.isEmpty():
        ends = left.union(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parents = ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("to"))
        for _ in range(2):
            further = parents.select(F.col("x").alias("to"), F.col("to").alias("_next"))
            parents = written(parents.join(further, "to", "left").select("x", F.coalesce("_next", "to").alias("to")))
        if moved is None:
            moved = parents
        else:
            later = parents.select(F.col("x").alias("to"), F.col("to").alias("_next"))
            passed = moved.join(later, "to", "left").select("x", F.coalesce("_next", "to").alias("to"))
            moved = written(passed.union(parents.join(passed.select("x"), "x", "left_anti").select("x", "to")))
        to = parents.select("x", "to")
        left = left.join(to, "x").select(F.col("to").alias("x"), "y")
        left = left.join(to.select(F.col("x").alias("y"), F.col("to").alias("z")), "y").select("x", F.col("z").alias("y"))
        left = written(left.filter("x <> y").distinct())
    if moved is None:
        return nodes
    joined = nodes.join(moved.select(F.col("x").alias("component"), "to"), "component", "left")
    return written(joined.select("id", F.coalesce("to", "component").alias("component")))


def with_leader(members: DataFrame, best: Column, threshold: int) -> DataFrame:
    """``a, b``: each member of a bucket with its leader, the one with the smallest ``best``, if they may be alike."""
    leader = F.min_by(F.struct("id", "component", "n", "shared"), F.struct(best, F.col("id")))
    buckets = members.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), leader.alias("_leader"))
    pairs = members.join(buckets.filter("_low <> _high").select("key", "_leader"), "key").filter("component <> _leader.component")
    pairs = pairs.filter(possible(F.col("n"), F.col("shared"), F.col("_leader.n"), F.col("_leader.shared"), threshold))
    return pairs.select(F.least("id", "_leader.id").alias("a"), F.greatest("id", "_leader.id").alias("b")).distinct()


def still_apart(members: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: pairs of a bucket in different components that may be alike without a rare member in common.

    A member whose common part is too small even for the smallest set of its bucket goes first; so most buckets are of
    one component then, and the others hold few members besides their main one.
    """
    mixed_up = [F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("n").alias("_least")]
    buckets = members.groupBy("key").agg(*mixed_up).filter("_low <> _high").select("key", "_least")
    least = F.greatest("_least", F.ceil(F.col("n") * threshold / 100))
    left = members.join(buckets, "key").filter(F.col("common") * (100 + threshold) >= (F.col("n") + least) * threshold)
    left = written(left.select("key", "id", "n", "common", "component"))
    left = written(left.join(left.groupBy("key").agg(*mixed_up).filter("_low <> _high").select("key"), "key", "left_semi"))
    other = left.select("key", *[F.col(c).alias(f"_{c}") for c in ("id", "n", "common", "component")])
    alike = possible(F.col("n"), F.col("common"), F.col("_n"), F.col("_common"), threshold)
    return left.join(other, "key").filter((F.col("component") < F.col("_component")) & alike).select(F.col("id").alias("a"), F.col("_id").alias("b"))


def sharing_rare(rare: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: pairs in different components that have a rare member in common (at most ``RARE`` sets each)."""
    held = rare.filter("sets > 1").select("member", "id").join(sizes.select("id", "n", "shared", "component"), "id")
    several = held.groupBy("member").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.collect_list(F.struct("id", "n", "shared", "component")).alias("_sets")
    ).filter("_low <> _high")
    pairs = several.select("_sets", F.explode("_sets").alias("x")).select("x", F.explode("_sets").alias("y"))
    alike = possible(F.col("x.n"), F.col("x.shared"), F.col("y.n"), F.col("y.shared"), threshold)
    return pairs.filter((F.col("x.component") < F.col("y.component")) & alike).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Null texts and texts without words have an empty set and are linked with nothing. Equal sets are linked. Repeated
    rows are linked with each other and share the verdict of their id. A null ``doc_id`` is not expected: such rows
    are kept, with no component. An empty table gives no rows.
    """
    rows = written(sketched(docs, size))
    known = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes)
    keys = banded(classes)
    buckets = keys.groupBy("key").agg(F.count("*").alias("_size")).filter("_size > 1").select("key")
    members = written(keys.join(buckets, "key"))
    ids = written(members.select("id").distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = written(shingled(docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), size))
    rare = written(rare_members(sets))
    own = rare.groupBy("id").agg(F.count_if(F.col("sets") == 1).alias("_lone"), F.count("*").alias("_rare"))
    sketches = classes.join(wanted, "id", "left_semi").join(own, "id", "left")
    left = [(F.col("n") - F.coalesce(c, F.lit(0))).alias(name) for c, name in (("_lone", "shared"), ("_rare", "common"))]
    sketches = written(sketches.select("id", "n", *left, "sketch"))
    # A set is like another only if enough of its members are in other sets at all.
    sizes = sketches.select("id", "n", "shared", "common").filter(F.col("shared") * 100 >= F.col("n") * threshold)
    members = written(members.join(sizes, "id").select("key", "id", "n", "shared", "common"))

    nodes = ids.select("id", F.col("id").alias("component"))
    # Two leaders: the one with the largest share of members in other sets, then any other, for those not yet joined.
    for best in (-F.col("shared") / F.col("n"), F.xxhash64("key", "id")):
        pairs = with_leader(members.join(nodes, "id"), best, threshold)
        nodes = components(nodes, confirmed(pairs, sketches, sets, threshold))
    apart = still_apart(members.join(nodes, "id"), threshold).union(sharing_rare(rare, sizes.join(nodes, "id"), threshold))
    pairs = written(apart.distinct())
    nodes = components(nodes, confirmed(pairs, sketches, sets, threshold))

    groups = classes.select("digest", "id").join(nodes, "id", "left").select("digest", F.coalesce("component", "id").alias("_component"))
    seek = F.coalesce("digest", F.encode(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"))
    found = rows.select("doc_id", "n_shingles", seek.alias("digest")).join(groups, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """``id, members``: the full set of a document as sorted 64-bit hashes."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingle_set(text, size, hashes).tobytes() for text in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "members"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(members, "id long, members binary").dropDuplicates(["id"])


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the smallest id stays.

    Rows that repeat an id stay or go together. Rows without words stay.
    """
    verdict = near_duplicates(docs, size, threshold)
    gone = written(verdict.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
