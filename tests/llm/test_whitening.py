"""Whitening against numpy's dense eigenvectors, and Lanczos on matrices with breakdowns and equal values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def dense(rows):
    """n, S, x, eigenvalues (falling) and vectors of the exact covariance."""
    length = max((len(v) for v in rows), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (length - len(v)) for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, centred, values[::-1], vectors[:, ::-1]


def check(frame, components=32):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in frame.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, sums, x, centred, values, vectors = dense([v for _, v in rows])
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    got = wh.whiten(frame, components=components).collect()
    assert len(got) == len(rows) * k
    expected = centred @ vectors[:, :k] / np.sqrt(values[:k])
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    deviation = sorted(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x)
    for j in range(1, k + 1):
        rs = by[j]
        assert sorted(r["deviation"] for r in rs) == deviation and {r["n"] for r in rs} == {n}
        assert abs(rs[0]["explained"] / (values[j - 1] / values.sum()) - 1) < 1e-9
        ids = [i for i, _ in rows]
        if len(set(ids)) == len(ids):
            mine = np.array([r["whitened"] for r in sorted(rs, key=lambda r: str(r["vec_id"]))])
            theirs = expected[np.argsort([str(i) for i in ids], kind="stable"), j - 1]
            assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_against_dense(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 40)) * np.linspace(3, 0.3, 40)
    check(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA).repartition(5))


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(2)
    check(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 5)) * [5, 4, 3, 2, 1])], SCHEMA))


def test_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [6, 5, 4, 3, 2, 1]).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), (104, []), (105, [2.0, 3.0]), (None, [9.0, -4.0, 0.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("clash"), "n": F.lit(0), "component": F.lit(1)})
    check(frame)
    check(frame.unionByName(frame))
    check(frame.where("vec_id < 4"))  # fewer rows than dimensions: fewer components
    for few in (frame.where("false"), frame.where("vec_id = 1"), spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], SCHEMA), spark.createDataFrame([(1, []), (2, [])], SCHEMA)):
        assert wh.whiten(few).count() == 0


def test_large_values(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3.0, 4.0])]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2} and any(r["deviation"] is None for r in got)
    middle = spark.createDataFrame([(i, [float(i * 1e12), float(-i)]) for i in range(6)], SCHEMA)
    n, sums, x, *_ = dense([[float(np.float32(i * 1e12)), float(-i)] for i in range(6)])
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in wh.whiten(middle).collect()} == {i: d if d < 2**63 else None for i, d in exact.items()}


@pytest.mark.parametrize("most", [24, 512])
def test_lanczos(most):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for values in (np.linspace(9, 0.1, 90), np.r_[np.full(12, 5.0), np.full(78, 1.0)], np.r_[3.0, 2.0, np.zeros(88)], 0.9 ** np.arange(90)):
        matrix = (q * values) @ q.T
        passes = []
        got, vectors = wh.lanczos(lambda b: passes.append(1) or matrix @ b, 90, 6, block=4, most=most)
        assert np.abs(got - np.sort(values)[::-1][:6]).max() < 1e-11 * values.max()
        assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11 * values.max()
