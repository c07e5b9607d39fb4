"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import spelling

SCHEMA = "doc_id long, text string, word string, form string, root string, n string, key string, red string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(rows, least_length=7, least_count=2, one_in=31, ratio=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in rows], SCHEMA)
    out = spelling.variants(table, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in out.collect())


def corpus(seed, n_docs, letters):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list(letters), rng.integers(6, 10))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * rng.random() ** 3)]
            if rng.random() < 0.25:
                k, c = int(rng.integers(0, len(w))), str(rng.choice(list(letters)))
                w = (w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:])[int(rng.integers(0, 3))]
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        rows.append((i, "; ".join(words)))
    return rows


@pytest.mark.parametrize(("letters", "options"), [
    ("abcdeñé", {}), ("ab", {"least_length": 4}), ("abcdefgh", {"pair_limit": 1}), ("ab", {"pair_limit": 0, "least_length": 3, "ratio": 2}),
    ("aéÀÿ×", {"alphabets": (2, 4), "pair_limit": 4}), ("abc", {"alphabets": (1,)})])
def test_variants_match_all_pairs(spark, letters, options):
    rows = corpus(len(letters), 50, letters)
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (70, ""), (71, "éÉ aaaaaaaa aaaaaaaa aaaaaaab x7x"), (72, "1234567 _______ 日本語日本語日本語")]
    brute = {k: v for k, v in options.items() if k in ("least_length", "ratio")}
    want = brute_variants(rows, **brute)
    assert len(want) > 20 and any(w[1] for w in want)
    assert got(spark, rows, **options) == want


def test_chains_reach_their_root(spark):
    # nine words in a row, each a letter longer and ten times as frequent as the one before
    rows = [(1, " ".join(["abcdefg" + "x" * k] * (2 * 4 ** k))) for k in range(7)]
    want = brute_variants(rows, one_in=1 << 40, ratio=4)
    assert {w[2] for w in want} == {"abcdefgxxxxxx"}
    assert got(spark, rows, one_in=1 << 40, ratio=4) == want


def test_awkward_rows_and_long_words(spark):
    docs = awkward_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = spelling.variants(docs)
    assert sorted((r.word, r.n) for r in out.collect()) == [(w[0], w[3]) for w in brute_variants(rows)]
    long = "ab" * 30_000
    rows = [(1, f"{long} {long}"), (2, f"{long}b {long}b {long[:-1]} {long[:-1]}")]
    assert got(spark, rows, one_in=1 << 40) == brute_variants(rows, one_in=1 << 40)
    assert spelling.variants(empty_docs(spark)).collect() == []


def test_pieces_never_cut_a_run():
    text = "abc déf, " * 50 + "x" * 100 + "!"
    for size in (1, 7, 64, 10_000):
        parts = list(spelling.pieces(text, size))
        assert "".join(parts) == text
        assert [r for p in parts for r in re.findall("[a-zà-ÿ]+", p)] == re.findall("[a-zà-ÿ]+", text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=9), st.integers(1, 40))
def test_neighbourhoods_hold_every_edit_once(word, cells):
    block, old = np.array([word], np.uint16), spelling.BLOCK_CELLS
    spelling.BLOCK_CELLS = cells
    try:
        keys = [int(k) for _, part in spelling.neighbour_keys(block, 4) for k in part]
    finally:
        spelling.BLOCK_CELLS = old

    def key(s):
        return int(spelling._finished(spelling._sums(np.array([s], np.uint16))[:, -1], len(s))[0])

    shorter = {tuple(word[:i] + word[i + 1:]) for i in range(len(word))}
    larger = {tuple(word[:i] + [s] + word[i + 1:]) for i in range(len(word)) for s in range(word[i] + 1, 4)}
    assert sorted(keys) == sorted(key(list(s)) for s in shorter | larger)
