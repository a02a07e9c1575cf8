"""Whitening against a full eigendecomposition."""

import numpy as np
import pytest

from tracklight.llm import whitening


def frame(spark, vectors, extra=()):
    rows = [(k, v) for k, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(rows, vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = c @ u / np.sqrt(e)
    got = np.full((n, k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s).astype(object) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / (c * c).sum() * n) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert len(rows) == n * k


@pytest.mark.parametrize(("d", "n", "k"), [(6, 40, 6), (64, 500, 32), (150, 400, 32)])
def test_equals_a_full_decomposition(spark, d, n, k):
    r = np.random.default_rng(d)
    vectors = (r.normal(size=(n, d)) * np.linspace(3, 0.2, d) + r.normal(size=d)).astype(np.float32).tolist()
    odd = [(900, None), (901, [float("nan")] * d), (902, [None] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, []), (905, [1.0] * (d + 1))]
    rows = whitening.whiten(frame(spark, vectors, odd).repartition(5)).collect()
    check(rows, vectors, k)


def test_lobpcg_certifies_its_residuals():
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 300))
    v = a @ np.diag(np.linspace(1, 0.01, 300) ** 4) @ a.T

    class Times:
        times = staticmethod(lambda b: v @ b)

    values, vectors, norms = whitening.lobpcg(Times, 300, 32)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:32], rtol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * values[0] >= norms.max()
    with pytest.raises(RuntimeError, match="residuals"):
        whitening.lobpcg(Times, 300, 32, passes=2)


def test_tables_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    # the third entry is constant, the second twice the first: one component
    rows = whitening.whiten(frame(spark, [[1.0, 2.0, 5.0], [3.0, 6.0, 5.0], [3.0, 6.0, 5.0]])).collect()
    assert [(r.vec_id, r.component) for r in sorted(rows)] == [(0, 1), (1, 1), (2, 1)]
    assert np.allclose(sorted(r.whitened for r in rows), sorted([-(2**0.5), 0.5**0.5, 0.5**0.5])) or np.allclose(sorted(r.whitened for r in rows), sorted([2**0.5, -(0.5**0.5), -(0.5**0.5)]))
    shared = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [2.0, 1.0], "b"), (None, [0.0, 0.5], "c")], "vec_id long, embedding array<float>, component string")
    assert sorted(str(r.vec_id) for r in whitening.whiten(shared).collect()) == ["1"] * 4 + ["None"] * 2


def test_deviations_of_very_large_numbers(spark):
    vectors = [[float(1 << 30), 0.0], [-float(1 << 30), 1.0], [0.0, 2.0]]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    want = {k: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for k, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in rows} == {k: w if w < 1 << 63 else None for k, w in want.items()}
