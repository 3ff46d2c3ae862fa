"""Whitening against numpy's own eigenvectors and exact integer arithmetic."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import whitening
from tidemark.llm.queries import op13_whitening
from llm_fixtures import sf_dir  # noqa: F401

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check_eigen(a):
    values, vectors = whitening.eigen(a)
    scale = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 * len(a)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 120])
def test_eigen_of_random_matrices(n):
    a = np.random.default_rng(n).standard_normal((n, n + 3))
    check_eigen(a @ a.T)


@pytest.mark.parametrize(
    "values",
    [np.ones(20), np.r_[np.ones(8) * 5, np.ones(7) * 2, np.arange(5)], np.r_[1.0, np.zeros(19)], 10.0 ** -np.arange(20), np.zeros(20)],
)
def test_eigen_of_clustered_spectra(values):
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((20, 20)))
    a = q @ np.diag(values) @ q.T
    check_eigen((a + a.T) / 2)


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    values = np.r_[rng.uniform(1e-6, 1, 5), -rng.uniform(1e-9, 1, 7)]
    sign = whitening.polar(q @ np.diag(values) @ q.T)
    assert np.abs(sign - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-6
    assert whitening.polar(np.zeros((3, 3))) is None
    assert whitening.polar(np.diag([1.0, 0.0])) is None


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 8), st.integers(0, 10_000))
def test_eigen_of_small_integer_matrices(n, seed):
    a = np.random.default_rng(seed).integers(-3, 4, (n, n)).astype(float)
    check_eigen(a + a.T)


def expected(vectors, components=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(dims)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, q = np.linalg.eigh(covariance)
    return n, deviation, centred, covariance, values[::-1], q[:, ::-1]


def check(rows, vectors, components=32):
    """``rows`` of the query against ``vectors`` by vec_id, which is their place."""
    n, deviation, centred, covariance, values, q = expected(list(vectors.values()))
    kept = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == n * kept
    table = np.zeros((n, kept))
    place = {v: i for i, v in enumerate(vectors)}
    for r in rows:
        i, j = place[r["vec_id"]], r["component"] - 1
        table[i, j] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["explained"] / (values[j] / np.trace(covariance)) - 1) < 1e-8
        assert r["identity_error"] < 1e-8
    w = centred @ q[:, :kept] / np.sqrt(values[:kept])
    sign = np.sign((table * w).sum(axis=0))
    assert np.abs(table * sign - w).max() < 1e-6
    assert np.abs(table.T @ table / n - np.eye(kept)).max() < 1e-8


def test_components_equal_plain_version(spark):
    rng = np.random.default_rng(7)
    scales = np.linspace(0.1, 3, 9)
    vectors = {i: (rng.standard_normal(9) * scales).tolist() for i in range(300)}
    rows = [(i, v, 1, 2.0) for i, v in vectors.items()]
    odd = [None, [None] * 9, [1.0] * 8 + [None], [float("nan")] + [0.0] * 8, [float("inf")] * 9, [], [1.0, 2.0]]
    rows += [(1000 + i, v, 1, 2.0) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened double").repartition(5)
    for components in (32, 4):
        out = whitening.components_of(df, components=components)
        assert out.columns == COLUMNS
        check(out.collect(), vectors, components)


def test_query_over_its_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    check(op13_whitening(spark, sf_dir).collect(), vectors)


def test_rank_deficient_repeated_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    line = [(i, [i * 1.0, i * 2.0, 5.0]) for i in range(20)]
    out = whitening.components_of(spark.createDataFrame(line + line, schema)).collect()
    assert len(out) == 40 and {r["component"] for r in out} == {1}  # one direction varies
    assert all(r["n"] == 40 and abs(r["explained"] - 1) < 1e-9 for r in out)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    for nothing in (same, same.where("false"), spark.createDataFrame([(1, None)], schema)):
        out = whitening.components_of(nothing)
        assert out.columns == COLUMNS and out.collect() == []


def test_whiten_keeps_other_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).tolist(), "x") for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `a b:c` string")
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "a b:c", "deviation", "whitened"]
    assert out.count() == 50
    with pytest.raises(Exception, match="below"):
        whitening.fit(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"))


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(10**9, [0, 0], np.ones(1), np.ones((2, 1)), np.ones(1), 0.0)
    out = model.deviations(np.array([[1, 1], [10, 10]]))
    assert out.to_pylist() == [2 * 10**18, None]
