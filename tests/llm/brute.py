"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(docs, size, percent=80):
    """doc_id -> (set size, component), for ``docs`` as (id, text)."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(docs, least=20):
    """doc_id -> (words, removed, digest of the kept words)."""
    first, found = {}, {}
    for i, text in sorted(docs):
        w = words(text)
        for at in range(len(w) - least + 1):
            first.setdefault(tuple(w[at : at + least]), (i, at))
    for i, text in docs:
        w, gone = words(text), set()
        for at in range(len(w) - least + 1):
            if first[tuple(w[at : at + least])] < (i, at):
                gone |= set(range(at, at + least))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        found[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return found


def rule_counts(text):
    """words, their characters, symbols, repeated lines, words in repeated windows of five."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source -> target, reshared step by step. ``sizes``: source -> words, None for no source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target
