import numpy as np

from pulsegrid.operators import training
from pulsegrid.plans import models

DATA = "/root/testdata/sf0.001"


def test_every_component_is_a_feature(spark, monkeypatch):
    width = len(spark.read.parquet(f"{DATA}/embeddings.parquet").first().embedding)
    seen = {}
    monkeypatch.setattr(training, "univariate", lambda df, features, label: seen.update(one=features))
    monkeypatch.setattr(training, "eliminate", lambda df, features, label, keep: seen.update(left=features))
    models.univariate_r2(spark, DATA)
    models.feature_elimination(spark, DATA)
    assert seen["one"] == seen["left"] == [f"f{i}" for i in range(width)] and width > 8
    assert models.pca_whitening(spark, DATA).count() == 1


def test_feature_job(spark):
    """Features of 8 s segments at 250 Hz against numpy on the same samples."""
    from pulsegrid.functions import kernels as K
    from pulsegrid.functions.segments import prepared
    from pulsegrid.plans import kernels as P

    folder = "/root/testdata/sf0.001"
    rows = {r.segment: np.array(r.x) for r in P.job_segments(spark, folder).collect()}
    got = {r.segment: r for r in P.feature_job(spark, folder).collect()}
    assert got.keys() == rows.keys() and len(got) > 20
    for k, x in list(rows.items())[:4]:
        raw = K.resample(x[None], 2000)
        ready = prepared(raw, 250)
        a = np.abs(np.fft.rfft(ready[0]))[:1000]
        power = a**2
        r = got[k]
        assert r.tcsc == K.threshold_crossings(ready[0], 250) and r.spen == K.sample_entropy(ready[0][-1250:])
        assert abs(r.fm - (np.arange(1000) * power).sum() / power.sum() / 8) < 1e-9
        assert r.count1 == K.resonance_counts(raw, 250, 1)[0] and r.amplitude == K.peak_amplitude(raw[0], 250)
        low = ready[0] - 0
        cells = lambda v: np.floor((v - low.min()) / np.ptp(low) * 39).astype(int)
        assert abs(r.psr - len(set(zip(cells(low[:-125]), cells(low[125:])))) / 1600) < 1e-9
        assert r.risk in (0, 1, 2) and all(v is not None and np.isfinite(v) for v in (r.tci, r.ste, r.mav, r.vf, r.m, r.a2, r.imf1_lz))


def test_univariate_and_trained_scores(spark, tmp_path):
    """Each feature's share of explained variance, and scores of a trained model, on a small table
    whose first feature tells the class."""
    from pulsegrid.plans import registry

    rng = np.random.default_rng(4)
    rows = [(i, [float(i % 2) * 4 - 2, -1 - abs(float(rng.standard_normal())), *rng.standard_normal(2).tolist()], i % 2) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = registry.queries()
    scores = {r.feature: r.r2 for r in q["univariate_r2"](spark, str(tmp_path)).collect()}
    assert len(scores) == 4 and max(scores, key=scores.get) == "f0" and scores["f0"] > 0.8
    assert q["train_and_score"](spark, str(tmp_path)).count() > 0


def test_fits_read_rows_that_are_written_once(spark, tmp_path, monkeypatch):
    """Elimination scales once and reads what it has written; its rounds drop what fits to those left would."""
    rng = np.random.default_rng(6)
    rows = [(*x, float(x[2] > 0)) for x in rng.standard_normal((150, 4)).tolist()]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, y double")
    seen, kept = [], training.written
    monkeypatch.setattr(training, "written", lambda df, name: seen.append(name) or kept(df, name))
    places = {r.feature: r.place for r in training.eliminate(df, ["f0", "f1", "f2", "f3"], "y", keep=1).collect()}
    assert seen == ["elimination"] and places["f2"] == 1 and sorted(places.values()) == [1, 2, 3, 4]
    held = df.withColumn("is_test", (training.F.rand(3) < 0.3).cast("int"))
    assert len(training.univariate(held, ["f0", "f2"], "y").collect()) == 2 and seen[1:] == ["univariate"]
