"""Fill-in-middle, spelling variants and token counts against plain versions, with the odd cases of the other operators."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import PAIRS, SCHEMA, docs, no_docs  # noqa: E402, F401

from tabwright.llm import fim, spelling, token_counts  # noqa: E402

ODD = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é\nü\n漢字\n\U0001f600 x", "<P>\nx\ny", "x <S> y\nz\n", "<M", "<\nP>\n<P", "a<\nS>b\n",
    "x\r\ny\r\n", " \n\x85\nq", "<P\n>\n<S\n>", "long " * 300_000 + "\n" + "tail\n" * 1000,
]


def texts_of(spark, texts, ids=None):
    rows = [(i, t, "x", "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, form string")


# ---- fill-in-middle ----------------------------------------------------------------------------------------------


def moved(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "suffix_first"), [(7, 100, 50), (1, 60, 0), (2, 100, 100), (3, 0, 50)])
def test_fim_moves_and_restores(spark, seed, rate, suffix_first):
    rng = random.Random(seed)
    made = ["".join(rng.choice(["a", "\n", "é", "<", "P", "S", "M", ">", "\U0001f600", " "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts = ODD + made
    got = fim.restored(fim.transformed(texts_of(spark, texts).repartition(3), seed, rate, suffix_first)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == moved(r.doc_id, texts[r.doc_id], seed, rate, suffix_first)
        assert r.restored == (texts[r.doc_id] or "")
    assert {r.form for r in got} == {"plain"} | ({"psm"} if rate and suffix_first < 100 else set()) | ({"spm"} if rate and suffix_first else set())


def test_fim_across_windows(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "WINDOW", 7)
    texts = [t for t in ODD[:-1] if t] + ["line\n" * 40]
    ids = pa.array([str(i) for i in range(len(texts))])
    got = fim.scatter(pa.array(texts), ids, 7, 100, 50)
    assert [tuple(x.values()) for x in got.to_pylist()] == [moved(i, t) for i, t in enumerate(texts)]
    assert fim.gather(got.field("output"), got.field("form")).to_pylist() == texts


def test_fim_on_documents(docs, no_docs):  # noqa: F811
    texts = dict(PAIRS)
    rows = fim.transformed(docs.union(docs)).collect()
    assert len(rows) == 2 * len(texts)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == moved(r.doc_id, texts[r.doc_id]) for r in rows)
    assert fim.restored(fim.transformed(no_docs)).count() == 0


def test_fim_takes_null_ids_and_refuses_broken_outputs(spark):
    rows = fim.transformed(texts_of(spark, ["a\nb\nc\n"], [None])).collect()
    assert [tuple(r)[1:] for r in rows] == [moved(None, "a\nb\nc\n")]
    broken = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="marker <M>"):
        fim.restored(broken).collect()


# ---- spelling variants -------------------------------------------------------------------------------------------


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(pairs, letters=6, times=5, form_times=5, dropped=199):
    n = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= times}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= form_times * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(seed, n_docs=150):
    """Documents with words and their misspellings of all kinds, frequent and rare, also of accented letters."""
    rng = random.Random(seed)
    letters = "eaionrstbvfwjqé÷ßÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(40)]
    pool = []
    for at, word in enumerate(base):
        pool += [word] * (30 if at % 2 else 6)
        for _ in range(4):
            k, kind = rng.randrange(len(word)), rng.randrange(3)
            near = word[:k] + (rng.choice(letters) if kind != 1 else "") + word[k + (kind != 2) :]
            pool += [near] * rng.choice([1, 3, 6])
            pool += [near[:-1]] * rng.randrange(2)
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n_docs)]
    texts += [None, "", "123 !", "É" * 30, ("Abcdefg " * 7) + "aBcdefg", "abcdefĀabcdef×÷"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("leaf", "upper"), [(64, 4000), (2, 4000), (1, 3)])
def test_spelling_groups(spark, monkeypatch, leaf, upper):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "UPPER_NODES", upper)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    pairs = spelled(leaf)
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in pairs], "doc_id long, text string, word string, n string").repartition(4)
    for options in ({}, {"letters": 3, "times": 2, "form_times": 2, "dropped": 5}, {"dropped": None}):
        named = {"letters": "least_letters", "times": "least_times"}
        got = spelling.spelling_groups(frame, **{named.get(k, k): v for k, v in options.items()}).collect()
        expected = grouped(pairs, **options)
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected
        assert any(f for _, f, *_ in expected)


def test_spelling_chains_have_one_root(spark):
    words = ["aaaaaa"] * 2 + ["aaaaab"] * 10 + ["aaaabb"] * 50 + ["aaabbb"] * 250 + ["zzzzzz"] * 2
    got = spelling.spelling_groups(texts_of(spark, [" ".join(words)]), least_times=2, dropped=None).collect()
    assert {(r.word, r.form, r.root) for r in got} == {
        ("aaaaaa", "aaaaab", "aaabbb"), ("aaaaab", "aaaabb", "aaabbb"), ("aaaabb", "aaabbb", "aaabbb"), ("aaabbb", None, "aaabbb"), ("zzzzzz", None, "zzzzzz"),
    }


def test_spelling_takes_long_texts_repeated_rows_and_none(spark, docs, no_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(spelling, "LONG_TEXT", 100)
    assert spelling.spelling_groups(no_docs).count() == 0
    once = {r.word: r.n for r in spelling.words(docs, 2, 1).collect()}
    assert {r.word: r.n for r in spelling.words(docs.union(docs), 2, 1).collect()} == {w: 2 * n for w, n in once.items()}
    long = texts_of(spark, ["abcdef " * 200_000 + "q" * 300_000, "q" * 300_000], [3, None])
    assert {(r.word[:6], r.n) for r in spelling.spelling_groups(long, least_times=2, dropped=None).collect()} == {("abcdef", 200_000), ("qqqqqq", 2)}


# ---- token counts ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


STRANGE = [
    None, "", " ", "   ", "a", " a", "a ", "  a  b   c ", "\n", "a\n\nb\tc\r\n  d", "▁", "▁▁a▁ b", "<s>", "</s> <unk> <0x0A>", "1234567 12.5e10", "\x00a\x00",
    "ﬁ é ①　x", "漢字かな交じり文です。テスト", "\U0001f600\U0001f468‍\U0001f469 ok", "é é", "a" * 5000, " " * 5000, "word" + " " * 33 + "word", "\x01\x02 \x03",
]


def test_counts_are_those_of_the_library(spark, docs, model):  # noqa: F811
    rng = random.Random(5)
    alphabet = ["the", " ", "  ", "\n", "é", "漢", "▁", "tion", "1", "x", "\U0001f600", "\t", "ing", ".", "<s>", "A"]
    texts = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + [t for _, t in PAIRS]
    for broadcast in (token_counts.BROADCAST_BYTES, 2_000, 0):
        got = {r.doc_id: r for r in token_counts.token_counts(texts_of(spark, texts).repartition(4), limit=50, broadcast_bytes=broadcast).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            n = len(model.encode(text or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 50), text


def test_each_distinct_pre_token_is_encoded_once(docs):  # noqa: F811
    held = token_counts.frequencies(docs).select(F.explode("pre").alias("pre"))
    table = token_counts.pieces(held.groupBy("pre").agg(F.count("*").alias("held")))
    assert table.count() == held.distinct().count()


def test_counts_of_repeated_rows_and_no_rows(docs, no_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 500)
    assert token_counts.token_counts(no_docs).count() == 0
    assert token_counts.token_counts(docs.union(docs)).count() == 2 * docs.count()
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_long_texts_are_counted_whole(spark, model):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(200_000))
    got = token_counts.token_counts(texts_of(spark, [long, long + " x"])).collect()
    assert [r.n_tokens for r in sorted(got)] == [len(model.encode(long)), len(model.encode(long + " x"))]
    assert all(r.over_limit for r in got)
