from __future__ import annotations

import random

import numpy as np
import pytest

from duotext.llm import ngramjoin
from duotext.llm.ngramjoin import ngram_join, prefix_of
from duotext.llm.setjoin import differing_bits, shingle_set, wide_sketch
from tests.llm.brute import components_of


def brute(texts: dict, width: int, percent: int) -> dict:
    sets = {}
    for i, text in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    found = components_of(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def varied(seed: int, n: int) -> dict:
    """Originals, copies with a word or two changed, texts of common words, and short ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [[word() for _ in range(rng.choice([3, 12, 60, 61, 150]))] for _ in range(n)]
    for _ in range(2 * n):
        copy = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def got(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent", "common", "flush"), [(4, 85, 1 << 16, 4_000_000), (2, 60, 0, 50), (3, 75, 5, 50)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, common, flush):
    monkeypatch.setattr(ngramjoin, "FLUSH", flush)  # counts are handed on in parts
    texts = varied(width, 60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert got(ngram_join(docs, width=width, percent=percent, common=common)) == brute(texts, width, percent)


def test_sets_of_one_prefix_are_one_group_and_are_told_apart(spark):
    # All share their first words and differ in common ones: whatever the order, groups of several arise.
    rng = random.Random(8)
    tail = [f"t{i}" for i in range(12)]
    texts = {i: " ".join(["a b c d e f g h"] * 1 + [rng.choice(tail) for _ in range(3)]) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(ngram_join(docs, width=1, percent=80, growth=2)) == brute(texts, 1, 80)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    known = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    ranks = rng.permutation(40) + 1
    for _ in range(200):
        base = np.concatenate([rng.integers(0, 1 << 63, 30).astype(np.uint64), rng.choice(known, 20, replace=False)])
        a, b = np.unique(base[rng.integers(0, 3) :]), np.unique(base[: 50 - rng.integers(0, 4)])
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert np.intersect1d(prefix_of(a, 85, known, ranks), prefix_of(b, 85, known, ranks)).size
    assert len(prefix_of(np.arange(1, dtype=np.uint64), 85, known, ranks)) == 1


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Ab c"), (5, "aB  C"), (5, "aB  C"), (None, "ab c"), (7, long), (8, long + " end"), (9, "é É"), (10, "É É")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, bucket string, node int")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs).collect()), key=repr)
    n = 300_000 - 3
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, 4), (7, n, 7), (8, n + 1, 7), (9, 1, 9), (10, 1, 10)], key=repr)
    empty = ngram_join(docs.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_wide_sketches_rule_out_large_disjoint_sets_and_no_similar_ones():
    rng = np.random.default_rng(2)
    for n in (600, 1000, 3000, 20_000):
        a, b = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), np.unique(rng.integers(0, 1 << 63, n + n // 4).astype(np.uint64))
        assert 175 * differing_bits(wide_sketch(a), wide_sketch(b)) > 25 * (len(a) + len(b))
        for share in (0.5, 0.86, 0.99):
            c = np.unique(np.concatenate([a[: int(share * n)], b[: int((1 - share) * n)]]))
            assert differing_bits(wide_sketch(a), wide_sketch(c)) <= len(np.setxor1d(a, c))
    assert wide_sketch(shingle_set(b"a b c d e f", 5)) is None
