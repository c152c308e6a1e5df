"""Operator 12 against numpy's eigenvalues, on full, deficient and odd tables."""

import math

import numpy as np
import pytest

from memspark.llm import whitening

SCHEMA = "label string, vec_id long, embedding array<double>, n int, whitened string"


def grid(v):
    return np.floor(np.asarray(v) * 64).astype(np.int64) + 1_000_000


def table(spark, vectors):
    return spark.createDataFrame([("clash", i, None if v is None else [float(x) if x is not None else None for x in v], 1, "clash") for i, v in vectors], SCHEMA).repartition(3)


def held(spark, vectors, most=32, least=1e-10):
    """The operator's rows, checked against a plain computation over the same vectors."""
    rows = whitening.whiten(table(spark, vectors), most).collect()
    x = np.array([grid(v) for _, v in vectors])
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, columns = np.linalg.eigh(y.T @ y / n)
    values, columns = values[::-1], columns[:, ::-1]
    rank = int((values > least * max(values[0], 1e-300)).sum())
    k = min(most, rank)
    assert len(rows) == n * k
    exact = {i: sum(int(d) ** 2 for d in n * g - sums) for (i, _), g in zip(vectors, x)}
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == exact[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-15)
        assert r.identity_error < 1e-8
    want = y @ columns[:, :k] / np.sqrt(values[:k])
    gaps = np.diff(values) / values[0] if len(values) > 1 else np.zeros(0)
    for c in range(k):
        apart = min([abs(g) for g in gaps[max(0, c - 1) : c + 1]], default=1)
        if apart > 1e-6:  # a single direction
            assert np.allclose(got[:, c] * np.sign(got[:, c] @ want[:, c]), want[:, c], atol=1e-6)
    assert k == 0 or np.allclose(got.T @ got / n, np.eye(k), atol=1e-8)


def test_full_rank(spark):
    rng = np.random.default_rng(1)
    held(spark, list(enumerate(rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) * 0.2)))


def test_fewer_components(spark):
    held(spark, list(enumerate(np.random.default_rng(2).normal(size=(60, 12)))), most=5)


def test_deficient(spark):
    """Fewer vectors than dimensions, equal dimensions, a constant one."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(9, 16))
    v[:, 3], v[:, 5] = v[:, 4], 0.25
    held(spark, list(enumerate(v)))


def test_equal_eigenvalues(spark):
    held(spark, list(enumerate(np.concatenate([np.eye(8), -np.eye(8)]))))


def test_ill_conditioned(spark):
    rng = np.random.default_rng(4)
    held(spark, list(enumerate(rng.normal(size=(500, 10)) * np.array([10.0**e for e in range(3, -2, -1) for _ in (0, 1)]))), least=1e-13)


def test_decomposition_of_a_graded_matrix():
    """Small eigenvalues are as exact, in proportion, as large ones."""
    rng = np.random.default_rng(5)
    d = 10.0 ** -np.arange(6)
    b = np.tril(rng.normal(size=(6, 6)) * 0.1, -1) + np.eye(6)
    v = (d[:, None] * b) @ (d[:, None] * b).T
    factor, order = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], rtol=1e-12, atol=0) and np.allclose(np.triu(factor, 1), 0)
    values, columns = whitening.jacobi(factor)
    singular = np.linalg.svd(factor, compute_uv=False)
    assert np.allclose(values, singular**2, rtol=1e-9, atol=0) and np.allclose(columns.T @ columns, np.eye(6), atol=1e-13)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(30, 6)))]
    odd = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0, 0]), (103, [float("nan")] * 6), (104, [float("inf"), 0, 0, 0, 0, 0]), (105, [1e300] * 6)]
    plain = sorted(map(tuple, whitening.whiten(table(spark, good)).select("vec_id", "component", "n", "deviation").collect()))
    assert plain == sorted(map(tuple, whitening.whiten(table(spark, good + odd)).select("vec_id", "component", "n", "deviation").collect()))
    assert len(plain) == 30 * 6
    # Another length is whitened by itself; a zero vector counts; a vec_id on two rows gives both.
    other = [(200, [0.0, 0.0]), (200, [1.0, 0.5]), (None, [2.0, 2.0]), (201, [0.5, -1.0])]
    more = [r for r in whitening.whiten(table(spark, good + other)).collect() if r.vec_id >= 200]
    assert sorted((r.vec_id, r.component, r.n) for r in more) == sorted((i, c, 3) for i in (200, 200, 201) for c in (1, 2))


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).count() == 0


def test_deviations_beyond_longs(spark):
    rows = whitening.whiten(table(spark, [(0, [1e8, 0.5]), (1, [-1e8, 0.25]), (2, [0.0, -3.0])])).collect()
    x = np.array([grid(v) for v in ([1e8, 0.5], [-1e8, 0.25], [0.0, -3.0])])
    exact = [sum(int(d) ** 2 for d in own) for own in (3 * x - x.sum(0)).tolist()]
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, e if e < 2**63 else None) for i, e in enumerate(exact)}
    assert any(e >= 2**63 for e in exact)
