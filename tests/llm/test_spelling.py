"""Spelling variants against brute force and SQL."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, low

from docfields.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least_letters=5, least_count=3, drop=97):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(low(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least_count}
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def prose(rng, n_docs):
    """Words over few letters, so that many are near, with marks, accents of the same group and other scripts between."""
    base = ["".join(rng.choice(list("abá÷"), size=rng.integers(4, 8))) for _ in range(400)]
    p = 1 / np.arange(1, len(base) + 1)
    for i in range(n_docs):
        w = rng.choice(base, size=150, p=p / p.sum())
        yield i * 7, rng.choice([" ", ", ", "\n", "1", "ж", "Ā", "𝒳"]).join(x.upper() if rng.random() < 0.2 else x for x in w)


@pytest.mark.parametrize("cell_words", [10_000, 15, 2])
def test_variants_equal_brute_force(spark, cell_words):
    rows = [*prose(np.random.default_rng(3), 60), (1, None), (2, ""), (3, "a b c"), (None, "abeab " * 9), (None, "abeab abebb"), (4, "x" * 20_000 + " "), (5, "x" * 20_001)]
    rows += [(900 + i, "y" * 3000 + " " + "y" * 3001) for i in range(4)]
    want = brute(rows)
    assert len(want) > 100 and any(w[5] > 0 and w[1] != w[2] for w in want)
    assert got(spelling.variants(documents(spark, rows).repartition(3), cell_words)) == want


def test_deleted_letters(spark):
    rows = [(i, "letters words letters") for i in range(200)]
    assert got(spelling.variants(documents(spark, rows), drop=3)) == brute(rows, drop=3)


def test_anagrams_in_blocks(spark, monkeypatch):
    """All words have the same letters but one: the last level is dealt into blocks of words and of searches."""
    monkeypatch.setattr(spelling, "CELL_SEARCHES", 2)
    from itertools import permutations

    words = ["".join(p) for p in permutations("abcde")] + ["".join(p) for p in permutations("abcdf")]
    rows = [(i, " ".join(words)) for i in range(3)]
    assert got(spelling.variants(documents(spark, rows), 20, drop=10**9)) == brute(rows, drop=10**9)


def test_chain_of_forms(spark):
    words = ["aaaaa" + "b" * i for i in range(12)]
    rows = [(1, " ".join(f"{w} " * (3 * 2 ** (11 - i)) for i, w in enumerate(words)))]
    out = got(spelling.variants(documents(spark, rows), drop=10**9))
    assert out == brute(rows, drop=10**9) and {r[2] for r in out} == {"aaaaa"}


def test_no_words(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "abc ,,")])).count() == 0
