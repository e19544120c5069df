"""Estimators on small tables that a line does not part."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pulsegrid.operators import training as M
from pulsegrid.operators.estimators import Boosted, FourierFeatures


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes by distance from the middle; a third feature says nothing."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (240, 3))
    y = np.digitize(np.hypot(x[:, 0], x[:, 1]), [0.5, 0.85])
    rows = [(k, *map(float, r), float(c)) for k, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, y double").coalesce(1).cache()


def accuracy(df):
    return df.agg(F.avg((F.col("truth") == F.col("predicted")).cast("int"))).first()[0]


@pytest.mark.parametrize("name,least", [("adaboost", 0.75), ("svc_rbf", 0.65), ("mlp2", 0.55)])
def test_estimators_learn_rings(rings, name, least):
    model = M.train(rings, ["f0", "f1", "f2"], "y", name)
    common = rings.groupBy("y").count().agg(F.max("count")).first()[0] / rings.count()
    assert accuracy(M.predict(model, rings, "y")) >= least > common


def test_kernel_of_random_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4))
    df = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], "k long, a array<double>").select("k", array_to_vector("a").alias("x"))
    out = FourierFeatures("x", "z", size=1000, gamma=0.2).transform(df).select("k", vector_to_array("z").alias("z"))
    z = np.array([r["z"] for r in out.orderBy("k").collect()])
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.2 * far)).max() < 0.2


def test_weights_follow_the_rows_that_are_wrong(spark):
    """One feature, labels 0 1 0: a stump errs, three of them do not."""
    df = spark.createDataFrame([(float(v), float(3 <= v < 6)) for v in range(9)], "f double, y double").select(array_to_vector(F.array("f")).alias("x"), "y")
    one = Boosted("x", "y", rounds=1, depth=1).fit(df)
    many = Boosted("x", "y", rounds=12, depth=1, every=2).fit(df)
    right = lambda m: m.transform(df).where("prediction = y").count()
    assert right(one) < 9 == right(many) and len(many.trees) > 2
    assert len(Boosted("x", "y", rounds=9, depth=3).fit(df).trees) == 1  # nothing is left to learn
    with pytest.raises(ValueError):
        Boosted("x", "y").fit(df.limit(0))
    with pytest.raises(ValueError):
        M.estimator("no such one", "y")


def test_experiment(rings):
    line = rings.withColumn("y", (F.col("f0") + 0.1 * F.col("f1") > 0).cast("double"))
    assert M.elimination_order(line, ["f2", "f1", "f0"], "y")[0] == "f0"
    found = M.experiment(line, ["f2", "f1", "f0"], "y", "svc_linear", 2, lambda k: F.xxhash64("id", F.lit(k)), keep=2).collect()
    runs, mean = found[:2], found[2]
    assert [r["iteration"] for r in found] == [0, 1, None] and sum(r["best"] for r in runs) == 1
    top = max(runs, key=lambda r: r["f1"])
    assert top["best"] and mean["f1"] == pytest.approx(sum(r["f1"] for r in runs) / 2) and mean["n"] == sum(r["n"] for r in runs) and min(r["accuracy"] for r in runs) > 0.85
