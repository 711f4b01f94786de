"""Whitening against a dense eigensolver, and its own eigensolver on hard matrices."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rowtide.llm.whitening import deviations, leading_components, whiten


def plain(vectors):
    """n, deviation, whitened and explained of each vector, as the contract has them."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1][:4], columns[:, ::-1][:, :4]
    white = (x - total / n) @ columns / np.sqrt(values)
    return n, ((n * x - total) ** 2).sum(axis=1), white, values / np.trace(centred.T @ centred / n)


def test_whitening_equals_dense_solver(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 12)) * rng.uniform(0.1, 2, 12)).astype(np.float32)
    vectors[200:] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12),
           (904, [1.0] * 5), (905, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)
    got = whiten(frame).toPandas().sort_values(["component", "vec_id"])
    n, deviation, white, explained = plain(vectors)
    assert len(got) == 4 * 300 and set(got["n"]) == {n} and n == 200
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for k in range(4):
        part = got[got["component"] == k + 1]
        assert part["vec_id"].tolist() == list(range(300))
        assert part["deviation"].tolist() == deviation.tolist()
        sign = np.sign(white[0, k] * part["whitened"].iloc[0])
        np.testing.assert_allclose(part["whitened"], sign * white[:, k], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(part["explained"], explained[k], rtol=1e-12)


@pytest.mark.parametrize("kind", ["random", "equal", "close", "blocks", "rank one", "diagonal", "scaled"])
def test_components_of_hard_matrices(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    values = {
        "random": rng.uniform(0, 9, 20), "equal": np.ones(20) * 3, "close": 5 + np.arange(20) * 1e-9,
        "blocks": np.repeat([7.0, 2.0], 10), "rank one": np.eye(20)[0] * 4, "diagonal": np.arange(20.0),
        "scaled": rng.uniform(0, 9, 20) * 1e-12,
    }[kind]
    a = np.diag(values) if kind in ("diagonal", "equal") else q * values @ q.T
    a = (a + a.T) / 2
    found, vectors = leading_components(a)
    want = np.sort(values)[::-1][:4]
    want = want[want > 1e-12 * want[0]]
    scale = want[0]
    np.testing.assert_allclose(found, want, rtol=1e-12, atol=1e-13 * scale)
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(want)), atol=1e-12)
    np.testing.assert_allclose(vectors @ a, found[:, None] * vectors, atol=1e-12 * scale)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<double>, component int, x int"
    rows = [(1, [0.5, 1.0, -0.5], 7, 7), (None, [0.25, 1.0, 2.0], 7, 7), (1, [0.5, 1.0, -0.5], 7, 7)]
    frame = spark.createDataFrame(rows, schema)
    got = whiten(frame).collect()
    assert [r.component for r in got] == [1, 1, 1] and {r.n for r in got} == {2}
    assert sorted(round(abs(r.whitened), 9) for r in got) == [1, 1, 1]
    assert whiten(frame.where("vec_id = 1")).collect() == []  # equal vectors have no component
    assert whiten(frame.limit(0)).collect() == []


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 3], [0, -2]])
    sums = [int(c) for c in x.sum(axis=0)]
    assert deviations(x, 2, sums) == [None, None]
    assert deviations(x[:, 1:], 2, sums[1:]) == [25, 25]
    far = np.array([[1 << 31], [0]])
    assert deviations(far, 2, [1 << 31]) == [1 << 62, 1 << 62]
