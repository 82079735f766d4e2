import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import whitening as w


def plain(vectors):
    """Whitening by NumPy's eigenvectors, up to sign: rows of (vec_id, whitened), shares, n, deviations."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, np.concatenate([x, np.zeros(d - len(x), np.int64)])) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(d, d))
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    return {i: ((x - s / n) @ v / np.sqrt(e), sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))) for i, x in kept}, e / np.trace(np.cov(fit.T.astype(float), bias=True).reshape(d, d)), n


def same(rows, vectors):
    want, explained, n = plain(vectors)
    assert {r.vec_id for r in rows} == set(want)
    got = {}
    for r in rows:
        assert r.n == n and r.deviation == want[r.vec_id][1] and r.identity_error < 1e-9 and r.deviation_digits is None
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[r.vec_id, r.component] = r.whitened
    for c in sorted({c for _, c in got}):
        ids = [i for i, k in got if k == c]
        a, b = np.array([got[i, c] for i in ids]), np.array([want[i][0][c - 1] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_fixture_against_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    same(w.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(30)]
    vectors += [(30, vectors[0][1]), (31, None), (32, [1.0, None, 0, 0, 0, 0]), (33, [math.nan] * 6), (34, [math.inf] + [0.0] * 5), (35, [0.5]), (36, []), (37, [-0.0] * 6)]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    df = df.withColumn("x", F.lit("x")).withColumn("n", F.lit("y")).withColumn("component", F.lit(0))
    rows = w.whiten(df).collect()
    same(rows, vectors)
    by = {(r.vec_id, r.component): r.whitened for r in rows}
    assert all(by[0, c] == by[30, c] for c in range(1, 5))


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert w.whiten(none).count() == 0
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    assert w.whiten(alike).count() == 0  # nothing varies
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [3.0, 6.0])], "vec_id long, embedding array<float>")
    rows = w.whiten(line).collect()
    assert len(rows) == 3 and {r.component for r in rows} == {1} and all(r.explained == 1.0 for r in rows)
    assert sorted(round(abs(r.whitened), 9) for r in rows) == [0.0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]


def test_equal_roots(spark):
    """Four axes of equal variance: any basis will do, but one for all rows, with unit covariance."""
    axes = [[(1.0 if i == j else 0.0) * sign for j in range(5)] for i in range(4) for sign in (1, -1)]
    rows = w.whiten(spark.createDataFrame(list(enumerate(axes)), "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 32 and all(r.identity_error < 1e-12 and abs(r.explained - 0.25) < 1e-12 for r in rows)


def test_large_entries(spark):
    rows = w.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in rows if r.vec_id != 3} == {None} and all(int(r.deviation_digits) > 1 << 63 for r in rows if r.vec_id == 1)


def test_exact_parts():
    rng = np.random.default_rng(0)
    ps = w.primes(2000)
    assert all(p % q for p in ps[:4] for q in range(2, 46341)) and math.prod(ps).bit_length() > 2000
    for d in (1, 2, 3, 6, 9):
        a = rng.integers(-9, 10, (d, d))
        assert (w.polynomial_mod(a % ps[1], ps[1]) == np.round(np.poly(a)).astype(int)[::-1] % ps[1]).all()
    singular = np.zeros((4, 4), np.int64)
    singular[3, 0] = 5
    assert w.polynomial_mod(singular, ps[0]).tolist() == [0, 0, 0, 0, 1]
    big = rng.integers(-(2**63), 2**63 - 1, (40, 3))
    assert (w.gram(big) == big.astype(object).T @ big.astype(object)).all()
    # (t - 1)^2 (t - 3) t
    roots = w.Roots([0, -3, 7, -5, 1])
    assert [roots.beyond(u, 0) for u in (-1, 0, 1, 2, 3)] == [4, 3, 1, 1, 0] and roots.positive() == 3
    for k, want in ((1, 3), (2, 1), (3, 1)):
        u, s = roots.largest(k)
        assert abs(u / 2**s - want) < 1e-15
