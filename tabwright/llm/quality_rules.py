"""Document quality rules with verdicts per host.

Each document is held to base rules and to stricter ones. Failures are counted per host; a host's failure rate is
shrunk towards the rate of all hosts with a beta prior fitted to them, so that a small host isn't judged by a few
documents. A host is bad if its rate is, with the stated certainty, above that of all hosts by a margin; its documents
must also pass the stricter rules. Where hosts don't differ, none is bad.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written

LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED = 0.20
SYMBOLS = "#*$%&|<>"
#: Stricter rules: shares of symbols and of repeated lines, bounds of the mean word length.
MOST_SYMBOLS = 0.10
MOST_DUP_LINES = 0.50
MEAN_WORD = (2.0, 15.0)
#: A host is bad if its failure rate is this much above the rate of all hosts, with a posterior probability of 0.95.
MARGIN = 0.1
CERTAIN = 1.645
#: Hosts with at least this share of the documents are joined by broadcast: at most 1 / HOT_HOST of them.
HOT_HOST = 0.005
BROADCAST_HOSTS = 200_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words lie in a window that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Ranks of windows, lengthened word by word: exact, without hashing.
    rank = coded
    for k in range(1, window):
        pairs = rank[: len(words) - k] * np.int64(len(ids) + 1) + coded[k:]
        _, rank = np.unique(pairs, return_inverse=True)
    _, rank, counts = np.unique(rank[:n], return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[rank] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    spaces = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    return (
        len(words), len(text or "") - spaces, sum(raw.count(c) for c in SYMBOLS.encode()),
        len(lines) - len(set(lines)), len(lines), repeated_words(words),
    )


def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS, dtype="int64")


def measured(docs: DataFrame) -> DataFrame:
    """``_row`` (the row as it is), ``doc_id``, ``source`` and the counts of the text."""
    count = F.pandas_udf(text_counts, ", ".join(f"{c} long" for c in COUNTS))
    plain = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        count(F.col("text").cast("string")).alias("_counts"),
    )
    return plain.select("_row", "doc_id", "source", "_counts.*")


def failures(counts: DataFrame) -> DataFrame:
    """Flags per rule. ``base_failed`` rejects a document anywhere, ``strict_failed`` on a bad host."""
    words, chars = F.col("n_words"), F.col("word_chars")
    rules = {
        "few_words": words < LEAST_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > words * round(100 * MOST_REPEATED),
        "symbols": F.col("n_symbols") > chars * MOST_SYMBOLS,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MOST_DUP_LINES,
        "word_length": (chars < words * MEAN_WORD[0]) | (chars > words * MEAN_WORD[1]),
    }
    flagged = counts.select("*", *[flag.alias(name) for name, flag in rules.items()])
    base, strict = F.col("few_words") | F.col("repeats"), F.col("symbols") | F.col("dup_lines") | F.col("word_length")
    return flagged.withColumn("base_failed", base).withColumn("strict_failed", strict)


RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def host_verdicts(flagged: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Per host: documents, failures per rule, shrunk failure rate and its lower bound, ``host_bad``. The null host is a host.

    The beta prior has the mean and the variance of the hosts' rates (weighted by documents), less what sampling adds
    to the variance. Hosts that don't differ give a strong prior: all rates shrink to the mean. The lower bound of a rate
    is that of a normal distribution with the moments of its beta posterior.
    """
    failed = (F.col("base_failed") | F.col("strict_failed")).cast("long")
    counts = [F.sum(F.col(r).cast("long")).alias(f"failed_{r}") for r in RULES]
    hosts = written(flagged.groupBy("source").agg(F.count("*").alias("n"), F.sum(failed).alias("failed"), *counts))
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(
        F.sum("n").cast("double").alias("n"), F.count("*").alias("hosts"), (F.sum("failed") / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * rate * rate).alias("squares"),
    ).first()  # one row
    mean, total = m["mean"] or 0.0, m["n"] or 1.0
    spread = mean * (1 - mean)
    between = max((m["squares"] or 0.0) / total - mean * mean - spread * m["hosts"] / total, spread * 1e-6, 1e-12)
    strength = max(spread / between - 1, 0.0)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    told = hosts.withColumn("rate", shrunk)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1)))
    told = told.withColumn("least_rate", F.col("rate") - F.lit(CERTAIN) * deviation)
    told = told.withColumn("host_bad", F.col("least_rate") > F.lit(mean + margin))
    return told.withColumn("_hot", F.col("n") >= F.lit(total * HOT_HOST))


def joined(flagged: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host verdicts joined back: ``host_bad`` and ``kept`` per document.

    Only bad hosts are looked up. Hot ones (a bounded number) are broadcast; so are the others up to a counted number,
    beyond it they are joined by a shuffle that hot hosts' rows take no part in.
    """
    bad = hosts.filter("host_bad").select(F.col("source").alias("_host"), F.lit(True).alias("_bad"), "_hot")
    hot, rest = bad.filter("_hot").select("_host", F.col("_bad").alias("_hot_bad")), bad.filter("NOT _hot").drop("_hot")
    found = flagged.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    seek = F.when(F.col("_hot_bad").isNull(), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rest = rest.select(F.coalesce(F.concat(F.lit("="), "_host"), F.lit("")).alias("_seek"), "_bad")
    rest = F.broadcast(rest) if rest.count() <= BROADCAST_HOSTS else rest
    found = found.withColumn("_seek", seek).join(rest, "_seek", "left")
    on_bad = F.coalesce("_hot_bad", "_bad", F.lit(False))
    found = found.withColumn("host_bad", on_bad).drop("_hot_bad", "_bad", "_seek")
    return found.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("strict_failed")))


def judged(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``doc_id, source``, counts, flags, ``host_bad`` and ``kept`` per row of ``docs``.

    A null text has no words and fails. The null host is a host. Repeated rows are separate documents with the same
    verdict. An empty table gives no rows.
    """
    flagged = failures(written(measured(docs).drop("_row")))
    return joined(flagged, host_verdicts(flagged, margin))


def kept_documents(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that `judged` keeps, with their columns. Texts aren't shuffled: they are read twice."""
    hosts = host_verdicts(failures(measured(docs).drop("_row")), margin)
    return joined(failures(measured(docs)), hosts).filter("kept").select("_row.*")
