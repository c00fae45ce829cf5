from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from duotext.llm.whitening import query_whitening, whitened_rows


def check(rows, out, components=4, scale=256):
    """Against numpy on the whole list, and the deviations in plain integers."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    trace = sum(values)
    assert len(out) == len(kept) * components
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    ratio = {}
    for i, x in kept:
        assert sorted(by_id[i]) == list(range(1, components + 1))
        for k, same in by_id[i].items():
            r = same[0]
            own = centred[fit.index(tuple(x))] @ vectors[:, -k] / math.sqrt(values[-k])
            assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            assert abs(r.explained - values[-k] / trace) <= 1e-9 and r.identity_error <= 1e-9
            ratio.setdefault(k, 1 if own * r.whitened >= 0 else -1)
            assert abs(r.whitened - ratio[k] * own) < 1e-8


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_rows_equal_numpy_with_copies_and_odd_rows(spark, block_rows):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, s) for s in (0.9, 0.5, 0.3, 0.2, 0.1, 0.05)]
    rows = [(i, vec()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)]  # copies weigh once
    odd = [(2000, None), (2001, [None, *[0.1] * 5]), (2002, [math.nan, *[0.1] * 5]), (2003, [-math.inf, *[0.1] * 5])]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<float>, index int").repartition(5)
    check(rows, whitened_rows(df, block_rows=block_rows).collect())


def test_repeated_rows_null_ids_other_lengths_and_empty_tables(spark):
    rows = [(1, [0.5, 0.0]), (1, [0.5, 0.0]), (None, [0.0, 0.25]), (3, [1.0, 1.0]), (4, [0.1]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitened_rows(df).collect()
    # Two dimensions: two components; vectors of other lengths are left out.
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]
    assert {r.n for r in out} == {3}
    assert whitened_rows(df.limit(0)).count() == 0 and whitened_rows(df.where("vec_id = 3")).count() == 0
    # On a line there is one component.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)], df.schema)
    out = whitened_rows(line).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


def test_query_on_the_small_table(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    check([(r.vec_id, r.embedding) for r in table], query_whitening(spark, sf_small).collect())
