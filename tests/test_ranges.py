"""Byte ranges of recordings: planning, pruning, long files, and writing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import ranges
from pulsegrid.sources import recordings as R
from pulsegrid.sources import writing

CHUNK = ranges.CHUNK


def series(df):
    out = {}
    for r in df.orderBy("record", "channel", "chunk").collect():
        out.setdefault((r.record, r.channel), {})[r.chunk] = np.array(r.samples)
    return out


def record(folder, name, x, form=16):
    n = x.shape[1]
    (folder / f"{name}.hea").write_text(f"{name} {n} 100 {len(x)}\n" + "".join(f"{name}.dat {form} 50 16 {k}\n" for k in range(n)))
    if form == 16:
        (folder / f"{name}.dat").write_bytes(x.astype("<i2").tobytes())
    elif form == 80:
        (folder / f"{name}.dat").write_bytes((x + 128).astype(np.uint8).tobytes())
    else:
        v = x.ravel().astype(int)
        v = np.append(v, 0) if len(v) % 2 else v
        v = v.reshape(-1, 2) & 0xFFF
        (folder / f"{name}.dat").write_bytes(np.stack([v[:, 0] & 255, (v[:, 0] >> 8) | (v[:, 1] >> 8) << 4, v[:, 1] & 255], axis=1).astype(np.uint8).tobytes())


@pytest.mark.parametrize("form,channels", [(16, 2), (80, 3), (212, 1), (212, 3)])
def test_ranges_hold_all_samples_once(spark, tmp_path, monkeypatch, form, channels):
    monkeypatch.setattr(ranges, "SPAN", 2)
    rng = np.random.default_rng(form)
    x = rng.integers(-100, 100, (5 * CHUNK + 777, channels))
    record(tmp_path, "a", x, form)
    plan = ranges.plan(R.plan_wfdb(spark, str(tmp_path)).drop("first", "count"), span=2)
    assert [(r["first"], r["count"]) for r in plan.orderBy("first").collect()] == [(0, 2), (2, 2), (4, 2)]
    found = series(ranges.read(plan))
    for k in range(channels):
        assert sorted(found["a", k]) == list(range(6))
        assert np.allclose(np.concatenate([found["a", k][c] for c in range(6)]), (x[:, k] - k) / 50)


def test_pruning_by_record_channel_and_time(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (4 * CHUNK, 2))
    for name in ("a", "b"):
        record(tmp_path, name, x)
    plan = R.plan_wfdb(spark, str(tmp_path))
    assert ranges.pruned(plan, ["a"]).count() == 1 and ranges.pruned(plan, channel=5).count() == 0
    assert ranges.pruned(plan, begin=1e9).count() == 0 and ranges.pruned(plan, end=0).count() == 0
    found = series(R.read_wfdb(spark, str(tmp_path), channel=1, records=["b"], begin=1.5 * CHUNK / 100, end=3 * CHUNK / 100))
    assert {k: sorted(v) for k, v in found.items()} == {("b", 1): [1, 2]}
    assert np.allclose(found["b", 1][2], (x[2 * CHUNK : 3 * CHUNK, 1] - 1) / 50)


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Most of it a hole; of the last two seconds only the last chunk is read."""
    n = 1_600_000_000
    (tmp_path / "big.hea").write_text(f"big 1 1000 {n}\nbig.dat 16 10(0) 16\n")
    with open(tmp_path / "big.dat", "wb") as file:
        file.truncate(2 * n)
        file.seek(2 * (n - 3))
        file.write(np.array([10, 20, -30], "<i2").tobytes())
    plan = R.plan_wfdb(spark, str(tmp_path))
    assert plan.agg(F.sum("count"), F.count("*")).first() == (-(-n // CHUNK), -(-n // CHUNK // ranges.SPAN))
    rows = R.read_wfdb(spark, str(tmp_path), begin=n / 1000 - 2).collect()
    assert [r["chunk"] for r in rows] == [n // CHUNK] and rows[0]["samples"][-4:] == [0.0, 1.0, 2.0, -3.0]


def test_vectorised_brainvision_and_markers(spark, tmp_path):
    x = np.arange(14, dtype="<i2").reshape(2, 7)
    (tmp_path / "b.vhdr").write_text("[Common]\nDataOrientation=VECTORIZED\nNumberOfChannels=2\nSamplingInterval=1000\n[Binary]\nBinaryFormat=INT_16\n[Channels]\nCh1=A,,0.5,uV\nCh2=B,,2,uV\n")
    (tmp_path / "b.eeg").write_bytes(x.tobytes())
    (tmp_path / "b.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0,20240101\nMk2=Stimulus,S 12,500,1,3\n")
    found = series(R.read_brainvision(spark, str(tmp_path)))
    assert found["b", 0][0].tolist() == (x[0] * 0.5).tolist() and found["b", 1][0].tolist() == (x[1] * 2.0).tolist()
    assert ranges.pruned(R.plan_brainvision(spark, str(tmp_path)), channel=1).count() == 1
    assert sorted(map(tuple, R.read_markers(spark, str(tmp_path)).collect())) == [("b", 0, "New Segment", "", 1, 0), ("b", 499, "Stimulus", "S 12", 1, 3)]


def test_written_recordings_come_back(spark, tmp_path):
    rng = random.Random(4)
    rows = [(name, t, [rng.randint(-40000, 40000), t]) for name, n in (("p1", 30), ("p2", 1), ("p3", 20000)) for t in range(n)]
    table = spark.createDataFrame(rows, "record string, t long, values array<int>").repartition(6)
    assert sorted(map(tuple, writing.write_wfdb(table, str(tmp_path), 100, [10, 1]).collect())) == [("p1", 30), ("p2", 1), ("p3", 20000)]
    found = series(R.read_wfdb(spark, f"file://{tmp_path}"))
    for name in ("p1", "p2", "p3"):
        mine = [v for n, _, v in rows if n == name]
        for k, gain in ((0, 10), (1, 1)):
            want = np.clip([v[k] for v in mine], -32768, 32767) / gain
            assert np.allclose(np.concatenate([x for _, x in sorted(found[name, k].items())]), want)
    marks = [(name, t, code, sub, aux) for name in ("p1", "p3") for t, code, sub, aux in ((3, "N", 0, ""), (9, "+", 0, "(VT"), (3000, "V", 2, ""), (300000, "~", -1, "x"))]
    ddl = "record string, t long, code string, sub_type int, aux string"
    writing.write_annotations(spark.createDataFrame([*marks, ("p1", 5, "no code", 0, "")], ddl), str(tmp_path)).count()
    assert sorted(map(tuple, R.read_annotations(spark, str(tmp_path)).collect())) == sorted(marks)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_ranges_of_many_small_files_are_dealt_over_all_tasks(spark, tmp_path):
    """A plan of few bytes would be coalesced into one task."""
    rows = spark.createDataFrame([(f"r{k}", 0, [k]) for k in range(40)], "record string, t long, values array<int>")
    writing.write_wfdb(rows, f"{tmp_path}/many", 1.0, [1.0]).count()
    found = R.read_wfdb(spark, f"{tmp_path}/many").select("record", "samples", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in found}) == 4
    assert {(r.record, *r.samples) for r in found} == {(f"r{k}", float(k)) for k in range(40)}
