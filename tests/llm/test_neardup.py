from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from duotext.llm import neardup
from duotext.llm.common import attach
from duotext.llm.graph import components
from duotext.llm.neardup import near_components
from duotext.llm.setjoin import halves, odd_sketch, set_key, shingle_set


@pytest.mark.parametrize("growth", [8])
def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch, growth):
    # One bucket holds all documents, whatever their sets: only the confirmation tells them apart.
    monkeypatch.setattr(neardup, "_signatures", _one_bucket)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = [[word() for _ in range(60)] for _ in range(40)]
    # Nodes are numbered by row: the near copies come last, far behind the hubs of the first rounds.
    texts += [[*texts[-1][:-1], word()], [*texts[2][:-1], word()]]
    n = len(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = near_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), growth=growth).collect()
    assert {r.doc_id: r.component_id for r in out} == {**{i: i for i in range(n)}, n - 2: n - 3, n - 1: 2}


def test_only_the_third_and_fourth_of_a_bucket_are_alike(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_signatures", _one_bucket)
    rng = random.Random(4)
    a, b, c, e = ([f"{rng.random()}" for _ in range(50)] for _ in range(4))
    rows = [(i, " ".join(t)) for i, t in enumerate([a, b, c, [*c[:-1], "x"], e])]
    out = near_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}


def _one_bucket(width, bins, rows):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), *halves(list(map(set_key, sets))), pa.array([[1]] * len(sets), pa.list_(pa.int64())), pa.array([odd_sketch(own) for own in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "odd"],
            )

    return run


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(1)
    for n in (3, 40, 300, 3000):
        for share in (0.5, 0.86, 0.99):
            both = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            common = int(share * n)
            a, b = both[:n], both[n - common : 2 * n - common]
            bits = sum(int(x).bit_count() for x in (odd_sketch(a) ^ odd_sketch(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))
            if n == 300 and share == 0.5:
                assert 175 * bits > 25 * 2 * n


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((60, 30), (200, 180), (40, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        # A path from end to end, so that following takes several jumps.
        edges += [(1000 + i, 1001 + i) for i in range(40)]
        root = {x: x for e in edges for x in e}
        for _ in range(len(root)):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root[x] for e in edges for x in e if e[0] != e[1]}


def test_hot_and_null_keys_are_attached(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else 7 if i % 2 else i) for i in range(4000)], "id long, k long")
    table = spark.createDataFrame([(7, 1600, "hot"), *((i, 1, f"v{i}") for i in range(2, 4000, 2) if i % 5 and i % 3)], "k long, n long, v string")
    got = {r.id: r.v for r in attach(rows, table, ["k"], "n").collect()}
    assert got == {i: None if i % 5 == 0 else "hot" if i % 2 else f"v{i}" if i % 3 else None for i in range(4000)}
