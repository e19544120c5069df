import math

import numpy as np
import pytest

from pulsegrid.sources import recordings as R
from pulsegrid.sources.shared import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def series(df):
    rows = df.orderBy("record", "channel", "chunk").collect()
    out = {}
    for r in rows:
        out.setdefault((r.record, r.channel), []).extend(r.samples)
    return {k: np.array(v) for k, v in out.items()}, {r.record: r.fs for r in rows}


def pack212(x):
    x = np.asarray(x).reshape(-1, 2) & 0xFFF
    return np.stack([x[:, 0] & 255, (x[:, 0] >> 8) | (x[:, 1] >> 8) << 4, x[:, 1] & 255], axis=1).astype(np.uint8).tobytes()


def test_wfdb(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(-2048, 2048, (20000, 2))
    (tmp_path / "r1.hea").write_text("r1 2 360 20000\nr1.dat 212 200(1024)/mV 11 1024 0 0 0 MLII\nr1.dat 212 100 11 5 0 0 0 V5\n")
    (tmp_path / "r1.dat").write_bytes(pack212(x.ravel()))
    y = rng.integers(-30000, 30000, 100).astype("<i2")
    (tmp_path / "r2.hea").write_text("# note\nr2 1 250\nr2.dat 16 50 16 10\n")
    (tmp_path / "r2.dat").write_bytes(y.tobytes())
    got, fs = series(R.read_wfdb(spark, str(tmp_path)))
    assert fs == {"r1": 360.0, "r2": 250.0}
    assert np.allclose(got["r1", 0], (x[:, 0] - 1024) / 200) and np.allclose(got["r1", 1], (x[:, 1] - 5) / 100) and np.allclose(got["r2", 0], (y - 10.0) / 50)
    assert set(series(R.read_wfdb(spark, str(tmp_path), channel=1))[0]) == {("r1", 1)}


def test_annotations(spark, tmp_path):
    rows = [(5, "+", 0, "(N"), (900, "N", 0, ""), (5000, "V", 3, ""), (200000, "~", -1, "odd"), (200001, "+", 0, "(VFIB")]
    (tmp_path / "a.atr").write_bytes(R.encode_annotations(rows))
    got = [tuple(r) for r in R.read_annotations(spark, str(tmp_path)).orderBy("t").collect()]
    assert got == [("a", *r) for r in rows]


@pytest.mark.parametrize("kind,size", [("edf", 2), ("bdf", 3)])
def test_edf(spark, tmp_path, kind, size):
    rng = np.random.default_rng(2)
    per, records = [4, 2], 5
    raw = [rng.integers(-(256**size) // 2, 256**size // 2, (records, p)) for p in per]
    pad = lambda v, n: str(v).ljust(n)[:n]
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad("", 16) + pad(256 * 3, 8) + pad("", 44) + pad(records, 8) + pad(2, 8) + pad(2, 4)
    low, high = -(256**size) // 2, 256**size // 2 - 1
    for values, width in ((("a", "b"), 16), (("", ""), 80), (("uV", "uV"), 8), ((-100, -100), 8), ((100, 100), 8), ((low, low), 8), ((high, high), 8), (("", ""), 80), (per, 8), (("", ""), 32)):
        head += "".join(pad(v, width) for v in values)
    body = b"".join((int(v) % 256**size).to_bytes(size, "little") for k in range(records) for r in raw for v in r[k])
    (tmp_path / f"e.{kind}").write_bytes(head.encode() + body)
    got, fs = series(R.read_edf(spark, str(tmp_path)))
    for k in range(2):
        assert np.allclose(got["e", k], (raw[k].ravel() - low) * 200 / (high - low) - 100)


def test_brainvision_and_raw(spark, tmp_path):
    x = np.arange(12, dtype="<i2").reshape(6, 2)
    (tmp_path / "b.vhdr").write_text("[Common]\nDataOrientation=MULTIPLEXED\nNumberOfChannels=2\nSamplingInterval=2000\n[Binary]\nBinaryFormat=INT_16\n[Channels]\nCh1=Fp1,,0.5,uV\nCh2=Fp2,,,uV\n")
    (tmp_path / "b.eeg").write_bytes(x.tobytes())
    got, fs = series(R.read_brainvision(spark, str(tmp_path)))
    assert fs == {"b": 500.0} and np.allclose(got["b", 0], x[:, 0] * 0.5) and np.allclose(got["b", 1], x[:, 1])
    (tmp_path / "s.001").write_bytes(np.array([1.5, -2], "<f4").tobytes())
    got, _ = series(R.read_raw(spark, str(tmp_path), "single", gain=2.0))
    assert got["s", 1].tolist() == [3.0, -4.0]


def test_corrections_and_catalog(spark, tmp_path):
    (tmp_path / "c.txt").write_text("r1 0 C\nr1\t8 (VF\nbroken line\n\nr2 16 X extra\nr0 4 X\n")
    rows = R.read_corrections(spark, str(tmp_path / "c.txt"))
    assert sorted(map(tuple, rows.collect())) == [("r0", 4, "X"), ("r1", 0, "C"), ("r1", 8, "(VF")]
    R.write_corrections(rows, str(tmp_path / "out"))
    assert R.read_corrections(spark, str(tmp_path / "out")).count() == 3
    (tmp_path / "list.txt").write_text("b\n a \n\n")
    assert [r.record for r in R.read_catalog(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]


def test_samples_are_divided_by_the_gain(spark, tmp_path):
    """5905 at a gain of 50 is 118.1, not one bit above it."""
    from pulsegrid.sources import writing

    rows = spark.createDataFrame([("a", 0, [5905]), ("a", 1, [-5987])], "record string, t long, values array<int>")
    writing.write_wfdb(rows, f"{tmp_path}/gain", 1.0, [50.0]).count()
    assert R.read_wfdb(spark, f"{tmp_path}/gain").first().samples == [118.1, -119.74]


def test_samples_beyond_16_bits_are_not_cut(spark, tmp_path):
    """Values of 655.36 and more do not fit 16 bits at a gain of 50; a null is no sample."""
    from pulsegrid.plans import files
    from pulsegrid.sources import writing

    values = [655.34, 655.36, 923.09, -1200.5, None, 40_000_000.0]
    rows = [(k, 3, k, "view", v, f'{{"k": {k}}}') for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string, value double, props string")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(at) AS ts", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.channel: (r.record, r.n, r.total, r.highest) for r in files.recording_samples(spark, str(tmp_path)).collect()}
    assert found == {0: (3, 6, round(sum(math.floor(v * 50 + 0.5) / 50 for v in values if v is not None), 4), 40_000_000.0), 1: (3, 6, 3.0, 1.0)}
    large = spark.createDataFrame([("a", 0, [1 << 31])], "record string, t long, values array<long>")
    with pytest.raises(Exception, match="does not fit 32 bits"):
        writing.write_wfdb(large, f"{tmp_path}/large", 1.0, [1.0], bits=32).count()


def test_files_of_queries_are_not_listed_by_the_driver(spark, tmp_path):
    """Names come from what was written: no plan has a list of files of the folder in it."""
    from pulsegrid.plans import files

    rows = [(k, k % 40, k, ("view", "signup", "error")[k % 3], float(k), f'{{"k": {k}}}') for k in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string, value double, props string")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(at) AS ts", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    for found in (files.recording_samples(spark, str(tmp_path)), files.files_to_labels(spark, str(tmp_path))):
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "parquet" in plan and "binaryFile" not in plan
        assert not [f for f in found.inputFiles() if f.endswith((".dat", ".hea", ".atr"))]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found = files.recording_samples(spark, str(tmp_path)).collect()
    assert {(r.record, r.channel, r.n, r.total) for r in found if r.channel == 0} == {(u, 0, 23 if u < 20 else 22, float(sum(range(u, 900, 40)))) for u in range(40)}


def test_named_records_are_read_as_listed_ones(spark, tmp_path):
    from pulsegrid.sources import writing

    rows = spark.createDataFrame([(f"r{k}", t, [k * t, -t]) for k in range(9) for t in range(k + 1)], "record string, t long, values array<int>")
    names = spark.createDataFrame(writing.write_wfdb(rows, f"file://{tmp_path}", 2.0, [4.0, 1.0]).collect())
    plain = lambda df: sorted((r.record, r.channel, r.chunk, r.fs, tuple(r.samples)) for r in df.collect())
    listed = plain(R.read_wfdb(spark, str(tmp_path)))
    assert len(listed) == 18 and plain(R.read_wfdb(spark, f"file://{tmp_path}", named=names)) == listed
    assert plain(R.read_wfdb(spark, str(tmp_path), channel=1, records=["r3"], named=names)) == [r for r in listed if r[:2] == ("r3", 1)]
    marks = spark.createDataFrame([("r1", 3, "N", 0, ""), ("r5", 4, "+", 1, "(VT")], "record string, t long, code string, sub_type int, aux string")
    marked = spark.createDataFrame(writing.write_annotations(marks, str(tmp_path)).collect())
    assert sorted(map(tuple, R.read_annotations(spark, str(tmp_path), named=marked).collect())) == sorted(map(tuple, marks.collect()))
