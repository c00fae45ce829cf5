from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from duotext.llm.centroids import centroid_clusters, nearest, query_centroids, walsh_hadamard


def brute(rows, k=40, rounds=5, dims=64, scale=256):
    """In plain integers."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [assign(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, of, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, assign(x)[1], assign(x)[0]) for i, x in kept), key=repr), centroids


def test_transform_keeps_distances_and_puts_coarse_coefficients_first():
    x = np.random.default_rng(0).integers(-500, 500, (50, 64))
    w = walsh_hadamard(x)
    assert (w[:, 0] == x.sum(axis=1)).all()
    d = lambda m: ((m[:, None] - m[None]) ** 2).sum(axis=2)
    assert (d(w) == 64 * d(x)).all()
    # The last coefficient changes its sign at every component.
    assert (w[:, 63] == (x * (-1) ** np.arange(64)).sum(axis=1)).all()


@pytest.mark.parametrize("dims", [1, 2, 8, 64])
def test_search_equals_all_distances_with_ties(dims):
    rng = np.random.default_rng(dims)
    x, c = rng.integers(-3, 4, (400, dims)), rng.integers(-3, 4, (40, dims))
    c[7] = c[3]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    of, distance = nearest(walsh_hadamard(x), walsh_hadamard(c))
    assert (of == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_clusters_equal_plain_integers(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(8)]) for i in range(300)]
    # A hot vector, repeated rows, rows that go.
    rows += [(1000 + i, [0.25] * 8) for i in range(150)] + [rows[5], rows[5]]
    rows += [(None, [0.1] * 8), (2000, None), (2001, []), (2002, [0.1] * 7), (2003, [math.nan] + [0.1] * 7), (2004, [math.inf] + [0.1] * 7), (2005, [None] + [0.1] * 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found, centroids = centroid_clusters(df, k=12, rounds=3, dims=8)
    want, final = brute(rows, 12, 3, 8)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=repr) == want
    assert centroids.tolist() == final


def test_few_none_and_too_large(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], "vec_id long, embedding array<float>")
    found, centroids = centroid_clusters(one, dims=2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0), (2, 0, 0)] and centroids.tolist() == [[128, -128]] * 2
    found, centroids = centroid_clusters(one.limit(0), dims=2)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and len(centroids) == 0
    with pytest.raises(PySparkException, match="lies beyond"):
        centroid_clusters(spark.createDataFrame([(1, [1e9, 0.0])], one.schema), dims=2)
    with pytest.raises(ValueError, match="power of two"):
        centroid_clusters(one, dims=3)


def test_query_adds_up(spark, sf_small):
    rows = query_centroids(spark, sf_small).collect()
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    want, centroids = brute([(r.vec_id, r.embedding) for r in table])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=repr) == want
    for r in rows[:50]:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
