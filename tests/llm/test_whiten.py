"""Whitening against exact sums and NumPy's covariance, and the eigen-solve on its own."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryspark.llm import queries, whiten

VECTORS = "vec_id long, embedding array<double>, component int, n long"


def plain(vectors):
    """(n, S, V) by exact arithmetic."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(d)] for i in range(d)]
    return np.array(x, object), sums, np.array(cov)


def check(rows, ids, vectors, most=32):
    x, sums, cov = plain(vectors)
    n = len(x)
    values = np.linalg.eigvalsh(cov)[::-1]
    keep = min(most, int(np.count_nonzero(values > 1e-12 * values[0])))
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, k) for i in ids for k in range(1, keep + 1))
    far = dict(zip(ids, (sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x)))
    white = {}
    for r in rows:
        assert r.n == n and r.deviation == far[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
        assert r.identity_error <= 1e-9
        white[r.vec_id, r.component] = r.whitened
    w = np.array([[white[i, k] for k in range(1, keep + 1)] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(keep)).max() < 1e-8
    # the components are V's: x - mean in their terms has V's products with itself
    centred = np.array([[float(Fraction(int(c)) - Fraction(s, n)) for c, s in zip(r, sums)] for r in x])
    back = centred.T @ w / n / np.sqrt(values[:keep])  # unit eigenvectors
    assert np.abs(cov @ back - back * values[:keep]).max() <= 1e-7 * values[0]
    return w


@given(st.integers(1, 12), st.integers(0, 2**32 - 1), st.booleans())
@settings(max_examples=40, deadline=None)
def test_symmetric_qr(d, seed, flat):
    rng = np.random.default_rng(seed)
    a = rng.integers(-2, 3, (d, d)).astype(float) if flat else rng.normal(size=(d, d)) * 10.0 ** rng.integers(-4, 5, d)
    v = a @ a.T
    values, vectors = whiten.symmetric_qr(v)
    size = max(np.abs(v).max(), 1e-300)
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * size * d


@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_parts_merge_to_the_whole(parts, seed):
    x = np.random.default_rng(seed).normal(size=(sum(parts), 3)) * [1, 10, 1000] + [0, 1e3, -1e3]
    total, at = whiten.Moments(3), 0
    for k in parts:
        own = whiten.Moments(3)
        for row in x[at : at + k]:  # one row at a time, the definition of the update
            own.stream(row[None])
        total.merge(own.n, own.mean, own.m2)
        at += k
    whole = whiten.Moments(3)
    whole.stream(x)
    assert total.n == whole.n == len(x)
    assert np.allclose(total.covariance(), np.cov(x.T, bias=True), atol=1e-7, rtol=1e-10)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), atol=1e-7, rtol=1e-10)


def test_query_on_all_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    check(queries.QUERIES["op11_whitening"](spark, sf_dir).collect(), table.vec_id.tolist(), table.embedding.tolist())


def test_many_tasks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 3)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(200, 5)) * [1, 2, 3, 40, 5] + [9, -9, 0, 100, 3]).round(3).tolist()
    vectors += vectors[:40] * 2
    rows = [(k, v, 7, 7) for k, v in enumerate(vectors)]
    check(whiten.whiten(spark.createDataFrame(rows, VECTORS).repartition(40)).collect(), [r[0] for r in rows], vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.0]), (2, [-1.0, 0.5, 0.0]), (None, [0.3, -2.0, 0.0]), (2, [-1.0, 0.5, 0.0])]
    odd = [(4, None), (5, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [-inf, 1.0, 1.0]), (10, [1.0, 2.0]), (11, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in good + odd], VECTORS)
    rows = whiten.whiten(df, components=32).collect()
    # the third dimension has no variance: two components
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((str(i), k) for i, _ in good for k in (1, 2))
    assert {r.n for r in rows} == {4}
    x, sums, cov = plain([v for _, v in good])
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, sum((4 * int(c) - s) ** 2 for c, s in zip(r, sums))) for (i, _), r in zip(good, x)}
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)
    for few in ([], good[:1], [good[1], good[3]], odd[:4]):
        assert whiten.whiten(spark.createDataFrame([(i, v, 0, 0) for i, v in few], VECTORS)).collect() == []


def test_numbers_too_large_are_told(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], 0, 0), (2, [-1e9, 0.0], 0, 0)], VECTORS)
    with pytest.raises(Exception, match="deviation does not fit"):
        whiten.whiten(df).collect()
