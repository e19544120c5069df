"""Decompositions against the dense answers of numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decomposition as D


def frame(spark, x, units=None):
    rows = [(int(units[k]) if units is not None else 0, [float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "unit long, x array<double>").repartition(3)


def test_components_equal_the_dense_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ np.diag([9, 5, 3, 2, 1, 0.001]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 7
    odd = spark.createDataFrame([(0, None), (0, [1.0]), (0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (0, [float("nan")] * 6)], "unit long, x array<double>")
    df = frame(spark, x).unionByName(odd)
    found = D.components(df, "x", 6)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert len(found.variances) == 5 and np.allclose(found.variances, values[:5]) and np.allclose(found.mean, x.mean(0))
    assert len(D.components(df, "x", 6, eigen_ratio=10).variances) == sum(values[0] <= 10 * values) and len(D.components(df, "x", 6, k=2).variances) == 2
    white = D.whitened(df, "x", found)
    y = np.array([r["white"] for r in white.where("white is not null").collect()])
    assert white.where("white is null").count() == 4 and np.allclose(np.cov(y.T), np.eye(5), atol=1e-8) and np.allclose(y.mean(0), 0, atol=1e-8)
    with pytest.raises(ValueError):
        D.components(odd, "x", 6)


def test_gram_of_resamples(spark):
    rng = np.random.default_rng(2)
    x, units = rng.normal(size=(120, 3)), rng.integers(0, 9, 120)
    df = frame(spark, x, units)
    found = D.matrices(D.gram(df, "x", 3, F.col("unit"), 4), 3)
    taken = {r["unit"]: r["w"] for r in df.select("unit", F.array(*(D.drawn(F.col("unit"), b) for b in range(4))).alias("w")).distinct().collect()}
    one = np.column_stack([x, np.ones(120)])
    assert np.allclose(found[-1], one.T @ one)
    for b in range(4):
        w = np.array([taken[u][b] for u in units])
        assert np.allclose(found.get(b, np.zeros((4, 4))), one.T @ (one * w[:, None]))
    assert 0.5 < np.mean(list(taken.values())) < 1.6


def test_stable_elements_are_told_from_noise(spark):
    rng = np.random.default_rng(3)
    units = np.repeat(np.arange(40), 5)
    shape = np.array([1.0, 1.0, -1.0, 0, 0, 0, 0, 0, 0, 0])
    x = rng.normal(3, 0.5, (200, 1)) * shape + rng.normal(0, 0.3, (200, 10))
    found = D.stable_vectors(frame(spark, x, units), "x", 10, F.col("unit"), k=1, boots=30)
    assert np.allclose(found.values, np.linalg.svd(x)[1][:1]) and np.allclose(np.abs(found.vectors[0] @ np.linalg.svd(x)[2][0]), 1)
    assert (found.q[0, :3] < 0.01).all() and (found.q[0, 3:] > 0.01).sum() >= 6


def test_rotation(spark):
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(8, 3)))[0].T
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    assert np.allclose(D.turned(base, turn @ base) @ turn @ base, base)
