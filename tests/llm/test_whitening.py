import math
from fractions import Fraction

import numpy as np
import pytest

from clonespark.llm.whitening import components, polarised, whiten


def brute(vectors, most=16):
    """All columns but the sign of the components, from exact fractions."""
    xs = {i: [math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = sorted(set(map(tuple, xs.values())))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(d)] for i in range(d)]
    values, axes = components(np.array(cov), most)
    far = {i: sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for i, v in xs.items()}
    white = {i: np.array([float(x - m) for x, m in zip(v, mean, strict=True)]) @ axes / np.sqrt(values) for i, v in xs.items()}
    return n, far, white, values / np.trace(np.array(cov))


def table(spark, vectors, extra=()):
    rows = [(i, [float(c) for c in v], "clash", 7) for i, v in vectors.items()] + [(i, v, "clash", 7) for i, v in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int")


def same(rows, vectors):
    n, far, white, share = brute(vectors)
    assert {r.vec_id for r in rows} == set(vectors)
    for r in rows:
        assert (r.n, r.deviation) == (n, far[r.vec_id] if far[r.vec_id] < 1 << 63 else None)
        assert len(r.whitened) == len(share)
        assert np.allclose(np.abs(r.whitened), np.abs(white[r.vec_id]), rtol=1e-7, atol=1e-7)
        assert np.allclose(r.explained, share, rtol=1e-6)
        assert r.identity_error < 1e-6


def test_equals_exact_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.2]) + 40
    vectors = dict(enumerate(base))
    vectors |= {100 + k: base[0] for k in range(40)}  # a common vector counts once
    odd = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [1.0, float("nan"), 1.0, 1.0, 1.0]), (503, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (504, []), (505, [1.0]), (506, [1e300] + [1.0] * 4)]
    same(whiten(table(spark, vectors, odd)).collect(), vectors)


def test_given_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = whiten(frame).collect()
    same(rows, {r.vec_id: r.embedding for r in frame.collect()})
    assert all(len(r.whitened) == 16 for r in rows)


@pytest.mark.parametrize("size", [1e3, 1e9, 1e14])
def test_wide_entries_stay_exact(spark, size):
    rng = np.random.default_rng(2)
    same(whiten(table(spark, dict(enumerate(rng.normal(size=(30, 3)) * size)))).collect(), dict(enumerate(np.random.default_rng(2).normal(size=(30, 3)) * size)))


def test_far_from_zero_loses_nothing():
    """Second moments in doubles would lose a variance of one unit beside a mean of 10^15."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (50, 4)) + 10**15
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    y = x - np.array([s // n for s in sums])
    squares = {(i, j): int(((y[:, i] + (y[:, j] if i != j else 0)) ** 2).sum()) for i in range(4) for j in range(i, 4)}
    assert np.allclose(polarised(n, sums, squares), np.cov((x - 10**15).T, bias=True), rtol=1e-13, atol=1e-15)


def test_without_variance(spark):
    rows = whiten(table(spark, {1: [1.0, 2.0], 2: [1.0, 2.0]})).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, [], [], 0.0)] * 2
    flat = whiten(table(spark, {k: [float(k), 5.0, 2.0 * k] for k in range(9)})).collect()  # rank one
    assert len(flat) == 9 and {len(r.whitened) for r in flat} == {1}


def test_empty_and_repeated_rows(spark):
    assert whiten(table(spark, {})).collect() == []
    frame = table(spark, {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.5, 0.1]}, [(None, [9.0, 9.0])])
    rows = whiten(frame.unionByName(frame)).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4} and sum(r.vec_id is None for r in rows) == 2
