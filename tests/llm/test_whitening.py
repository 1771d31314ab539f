"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest

from corrobora.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def expect(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (x * n - s) / n
    values, q = np.linalg.eigh(z.T @ z / n)
    return n, ((x * n - s) ** 2).sum(axis=1), values[::-1], z @ q[:, ::-1]


def check(rows, vectors, k):
    n, deviation, values, projected = expect(vectors)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(vectors) * k
    white = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in range(len(vectors))])
    ref = projected[:, :k] / np.sqrt(values[:k])
    assert np.abs(white * np.sign((white * ref).sum(axis=0)) - ref).max() < 1e-8
    assert [by[i, 1]["deviation"] for i in range(n)] == deviation.tolist()
    assert np.allclose([by[0, c]["explained"] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-8


def test_components_equal_numpys(spark):
    vectors = (np.random.default_rng(0).standard_normal((300, 40)) * np.linspace(3, 0.5, 40)).tolist()
    rows = W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA).repartition(5)).collect()
    check(rows, np.array(vectors, np.float32).tolist(), 32)


def test_sums_by_spark_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(W, "DIRECT", 0)
    vectors = np.random.default_rng(1).standard_normal((60, 6)).round(2).tolist()
    check(W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA), 3).collect(), vectors, 3)


def test_odd_rows(spark):
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [0.0, 0.25, -1.0], [4.0, -2.0, 0.0], [4.0, -2.0, 0.0]]
    odd = [None, [], [1.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    rows = [(i, v, "x", 7) for i, v in enumerate(good)] + [(100 + i, v, None, 7) for i, v in enumerate(odd)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA + ", component string, n int"))
    check(found.collect(), good, 3)
    ids = spark.createDataFrame([(None, good[0]), (2**60 + 1, good[1]), (2**60 + 2, good[2])], SCHEMA)
    assert {r["vec_id"] for r in W.whiten(ids).collect()} == {None, 2**60 + 1, 2**60 + 2}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None]])
def test_without_variance_there_are_no_components(spark, vectors):
    assert W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)).collect() == []


def test_rank_bounds_the_components(spark):
    vectors = [[float(i), 2.0 * i, 1.0] for i in range(20)]
    check(W.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect(), vectors, 1)


def test_deviations_that_pass_64_bits_on_the_way_are_exact():
    x = np.array([[1_000_000_000, 0], [0, 0]])
    n, sums = 3, np.array([1_000_000_000, 0])
    assert W.deviations(x, n, sums) == [4 * 10**18, 10**18]
    with pytest.raises(OverflowError):
        W.deviations(x * 10, n, sums)


@pytest.mark.parametrize("values", [np.linspace(1, 100, 200), np.r_[np.full(30, 7.0), np.full(170, 1.0)], 1 / np.arange(1, 201.0) ** 2, np.r_[np.full(5, 2.0), np.zeros(195)]])
def test_largest_pairs_of_an_operator(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = W.largest_pairs(lambda c: a @ c, 200, 12, block=4)
    assert np.allclose(found, np.sort(values)[::-1][:12], atol=1e-10 * values.max())
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-11 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ W.minres(lambda c: a @ c, b, 60) - b).max() < 1e-8
