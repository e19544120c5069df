"""Versions of a feature store."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.store import Store, VersionConflict, quantised, restored


def table(spark, rows):
    return spark.createDataFrame(rows, "db string, id long, a double, b double")


def test_versions_stay_as_they_were(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(LookupError):
        store.read()
    assert store.create(table(spark, [("x", 1, 1.0, 10.0), ("x", 2, 2.0, 20.0), ("y", 1, 3.0, 30.0)]), ["db", "id"]) == 1
    new = spark.createDataFrame([("x", 1, 9.0, "n"), ("y", 1, None, "m")], "db string, id long, a double, c string")
    assert store.update(new) == 2
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(store.read()) == [("x", 1, 9.0, 10.0, "n"), ("x", 2, 2.0, 20.0, None), ("y", 1, 3.0, 30.0, "m")]
    assert got(store.read(version=1)) == [("x", 1, 1.0, 10.0), ("x", 2, 2.0, 20.0), ("y", 1, 3.0, 30.0)]
    assert store.manifest(1)["groups"]["b"] == store.manifest(2)["groups"]["b"]  # b was not written again
    files = " ".join(store.read(["b"]).inputFiles())
    assert store.manifest(2)["groups"]["b"] in files and store.manifest(2)["groups"]["a"] not in files
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([("z", 9, 1.0)], "db string, id long, a double"))
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([("x", 1, 1.0), ("x", 1, 2.0)], "db string, id long, a double"))
    with pytest.raises(VersionConflict):  # made from the first version, which is no longer the last
        store.update(new, version=1)
    assert store.versions() == [1, 2]


def test_a_commit_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.create(table(spark, [("x", 1, 1.0, 10.0)]), ["db", "id"])

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        store.update(spark.createDataFrame([("x", 1, 5.0)], "db string, id long, a double"))
    monkeypatch.undo()
    later = Store(spark, str(tmp_path))
    assert later.versions() == [1] and [tuple(r) for r in later.read().collect()] == [("x", 1, 1.0, 10.0)]
    assert len(later.sweep()) == 1 and later.sweep() == [] and later.read().count() == 1


def test_quantised_samples_are_within_half_a_step(spark, tmp_path):
    x = [0.0, 1.23456, -3.2, 100.0, -100.0]
    rows = spark.createDataFrame([("x", 1, x), ("x", 2, None)], "db string, id long, x array<double>")
    store = Store(spark, str(tmp_path))
    store.create(rows.select("db", "id", quantised(F.col("x"), 500.0, "x")), ["db", "id"])
    raw = spark.read.parquet(f"{tmp_path}/{store.manifest()['groups']['x']}")
    assert dict(raw.dtypes)["x"] == "array<smallint>" and raw.schema["x"].metadata == {"gain": 500.0}
    found = {r["id"]: r["x"] for r in store.read().collect()}
    assert found[2] is None and all(abs(a - b) <= 0.5 / 500 for a, b in zip(found[1][:3], x[:3]))
    assert found[1][3:] == [32767 / 500, -32768 / 500] and restored(rows).schema == rows.schema
