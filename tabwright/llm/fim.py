"""Fill-in-middle transformation by displacement scatter.

Each text is cut at two line ends into prefix, middle and suffix, which change places behind markers. A batch of texts is
one array of bytes: a scan finds the cuts, a difference array holds how far the bytes from each cut on move, its running
sum is the displacement of every byte, and one scatter writes the outputs of the whole batch. Restoring works the other
way round: the markers of an output give the cuts, and a gather by displacements rebuilds the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Of 100 documents, how many are transformed, and how many of those have the suffix first.
RATE = 100
SUFFIX_FIRST = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
#: Displacements are 8 bytes per byte of text; they are made for this many bytes at a time.
WINDOW = 1 << 20
NEWLINE, OPENS, CLOSES = b"\n<>"
NAMES = np.frombuffer(b"PSM", np.uint8)
TRANSFORMED = "n long, form string, prefix_chars long, middle_chars long, output string"


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch and where each starts (one more: the end). A null text is empty."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts whose bytes lie behind each other in ``data``."""
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def scan(data: np.ndarray, found) -> np.ndarray:
    """Positions where ``found(bytes)`` holds, window by window; a window sees two bytes of the next one."""
    parts = [np.flatnonzero(found(data[at : at + WINDOW + 2])[:WINDOW]) + at for at in range(0, len(data), WINDOW)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def marked(data: np.ndarray) -> np.ndarray:
    """Where a marker starts."""
    is_mark = np.zeros(len(data), bool)
    if len(data) >= MARK:
        is_mark[:-2] = (data[:-2] == OPENS) & (data[2:] == CLOSES) & np.isin(data[1:-1], NAMES)
    return is_mark


def marks_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the markers that lie within one text, and the number of that text."""
    at = scan(data, marked)
    owner = np.searchsorted(bounds, at, "right") - 1
    inside = at + MARK <= bounds[owner + 1]
    return at[inside], owner[inside]


def moved(starts: np.ndarray, shifts: np.ndarray, size: int):
    """Per window ``(from, to, displacement of each byte)``; bytes from ``starts[i]`` on move by ``shifts[i]``.

    Of stretches that start at one byte only the last has bytes: the differences of the others cancel out.
    """
    steps = np.diff(shifts, prepend=0)
    at = np.searchsorted(starts, np.arange(0, size + WINDOW, WINDOW))
    carried = 0
    for window, begin in enumerate(range(0, size, WINDOW)):
        end = min(begin + WINDOW, size)
        difference = np.zeros(end - begin, np.int64)
        mine = slice(at[window], at[window + 1])
        np.add.at(difference, starts[mine][starts[mine] < end] - begin, steps[mine][starts[mine] < end])
        shift = np.cumsum(difference) + carried
        carried = shift[-1]
        yield begin, end, shift


def draws(doc_id: str | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def places(starts, prefix, middle, suffix, plain, suffix_first):
    """Where prefix, middle and suffix of each text go, behind ``starts`` of the outputs; a plain text has no markers."""
    mark = np.where(plain, 0, MARK)
    first = starts + mark
    prefix_at = np.where(suffix_first, first + suffix + mark, first)
    suffix_at = np.where(suffix_first, first, first + prefix + mark)
    middle_at = first + prefix + suffix + 2 * mark
    plain_middle = starts + prefix
    return prefix_at, np.where(plain, plain_middle, middle_at), np.where(plain, plain_middle + middle, suffix_at)


def scatter(texts: pa.Array, ids: pa.Array, seed: int, rate: int, suffix_first: int) -> pa.Array:
    """A batch of texts to a batch of `TRANSFORMED`."""
    data, bounds = raw(texts)
    starts, ends = bounds[:-1], bounds[1:]
    length = ends - starts
    newlines = scan(data, lambda b: b == NEWLINE)
    left, right = np.searchsorted(newlines, starts), np.searchsorted(newlines, ends)
    unended = np.zeros(len(starts), bool)
    unended[length > 0] = data[ends[length > 0] - 1] != NEWLINE
    n = right - left + unended
    h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
    first, last = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))

    def cut(units: np.ndarray) -> np.ndarray:
        inner = (units > 0) & (units < n)
        found = np.where(units > 0, ends, starts)
        found[inner] = newlines[left[inner] + units[inner] - 1] + 1
        return found

    one, two = cut(first), cut(last)
    plain = (length == 0) | (h[:, 2] % 100 >= rate)
    plain[marks_of(data, bounds)[1]] = True
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    prefix, middle, suffix = one - starts, two - one, ends - two
    out_bounds = np.concatenate([[0], np.cumsum(length + np.where(plain, 0, 3 * MARK))])
    prefix_at, middle_at, suffix_at = places(out_bounds[:-1], prefix, middle, suffix, plain, spm)
    out = np.empty(out_bounds[-1], np.uint8)
    cuts = np.column_stack([starts, one, two]).ravel()
    shifts = np.column_stack([prefix_at - starts, middle_at - one, suffix_at - two]).ravel()
    for begin, end, shift in moved(cuts, shifts, len(data)):
        out[np.arange(begin, end) + shift] = data[begin:end]
    for mark, at in ((PREFIX, prefix_at), (SUFFIX, suffix_at), (MIDDLE, middle_at)):
        out[(at[~plain] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(mark.encode(), np.uint8)

    def chars(begin: np.ndarray, end: np.ndarray) -> pa.Array:
        counts = [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in zip(begin, end, strict=True)]
        return pa.array(counts, pa.int64(), mask=plain)

    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), form, chars(starts, one), chars(one, two), strings(out, out_bounds)], [c.split()[0] for c in TRANSFORMED.split(", ")]
    )


def gather(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that `scatter` made ``outputs`` of, from these and their forms alone."""
    data, bounds = raw(outputs)
    form = np.array(forms.to_pylist(), dtype=object)
    plain, spm = form == "plain", form == "spm"
    at, owner = marks_of(data, bounds)
    kept = ~plain[owner]
    at, owner, which = at[kept], owner[kept], data[at[kept] + 1]
    out_starts, out_ends = bounds[:-1], bounds[1:]
    where = {}
    for name in "PSM":
        mine = which == ord(name)
        if not np.array_equal(owner[mine], np.flatnonzero(~plain)):
            raise ValueError(f"an output must have the marker <{name}> once")
        where[name] = out_starts.copy()
        where[name][~plain] = at[mine] + MARK
    # Each part ends at the next marker or at the end of the output.
    middle = out_ends - where["M"]
    first = np.where(spm, where["P"], where["S"]) - MARK - np.where(spm, where["S"], where["P"])
    second = where["M"] - MARK - np.where(spm, where["P"], where["S"])
    prefix, suffix = np.where(spm, second, first), np.where(spm, first, second)
    prefix[plain], middle[plain], suffix[plain] = (out_ends - out_starts)[plain], 0, 0
    text_bounds = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    starts = text_bounds[:-1]
    cuts = np.column_stack([starts, starts + prefix, starts + prefix + middle]).ravel()
    shifts = np.column_stack([where["P"] - starts, where["M"] - (starts + prefix), where["S"] - (starts + prefix + middle)]).ravel()
    texts = np.empty(text_bounds[-1], np.uint8)
    for begin, end, shift in moved(cuts, shifts, len(texts)):
        texts[begin:end] = data[np.arange(begin, end) + shift]
    return strings(texts, text_bounds)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, number of lines ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` per row of ``docs``.

    Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), ``plain`` (the text as it is: empty texts,
    those that hold a marker, and the share that ``rate`` leaves out; no character counts). The choice depends on
    ``doc_id`` and ``seed`` only, so repeated rows have equal results. A null text is empty, a null id counts as no digits.
    An empty table gives no rows; further columns are ignored. Long texts need their own size three times, no more.
    """
    move = F.arrow_udf(lambda texts, ids: scatter(texts, ids, seed, rate, suffix_first), TRANSFORMED)
    plain = docs.select("doc_id", move(F.col("text").cast("string"), F.col("doc_id").cast("string")).alias("_moved"))
    return plain.select("doc_id", "_moved.*")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with ``output`` and ``form``) and the text rebuilt from these two, as ``restored``.

    An output whose form says so but that lacks a marker is refused.
    """
    return outputs.withColumn("restored", F.arrow_udf(gather, "string")("output", "form"))
