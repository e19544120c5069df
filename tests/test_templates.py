"""Template matching: a stream gives what a table gives, and state stays bounded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming import runs, templates
from pulsegrid.streaming.templates import Bank


def wave(kind, rng, n=100, noise=2.0, height=1.0, shift=0):
    x = (np.arange(n) - n // 2 - shift) / n
    base = {0: 100 * np.exp(-((x / 0.05) ** 2)), 1: -80 * np.exp(-((x / 0.12) ** 2)) + 60 * np.exp(-(((x - 0.15) / 0.05) ** 2)), 2: 90 * np.sin(25 * x) * np.exp(-((x / 0.1) ** 2))}[kind]
    return height * base + np.array([rng.gauss(0, noise) for _ in range(n)])


def slow_difference(shape, beat, shift):
    """The metric point by point."""
    n, length = len(shape), len(shape) // 2
    start = (n - length) // 2
    middle = [shape[start + i] for i in range(length)]
    high, other = max(middle) - min(middle), max(beat[start : start + length]) - min(beat[start : start + length])
    best = None
    for by in range(-shift, shift + 1):
        off = [middle[i] - beat[start + i + by] * high / other for i in range(length)]
        total = sum(abs(o - sum(off) / length) for o in off)
        if best is None or total < best[0]:
            best = (total, by)
    return best[0] / (2 * high) * 30 / length, best[1]


def test_difference_point_by_point():
    rng = random.Random(3)
    for _ in range(30):
        a, b = wave(rng.randrange(3), rng), wave(rng.randrange(3), rng, height=rng.uniform(0.5, 2), shift=rng.randint(-3, 3))
        got, want = templates.difference(a, b, 4), slow_difference(list(a), list(b), 4)
        assert got == (pytest.approx(want[0]), want[1])
    assert templates.difference(np.zeros(20), np.arange(20.0), 2) == (templates.NO_MATCH, 0)


def test_shapes_are_told_apart_whatever_their_height_and_shift():
    rng = random.Random(5)
    kinds = [rng.randrange(3) for _ in range(300)]
    bank = Bank(4)
    names = [bank.take(wave(k, rng, height=rng.uniform(0.7, 1.4), shift=rng.randint(-2, 2)))[0] for k in kinds]
    by = {k: {n for n, kk in zip(names, kinds) if kk == k} for k in range(3)}
    assert all(len(n) == 1 for n in by.values()) and len(set.union(*by.values())) == 3
    assert sum(s.count for s in bank.shapes) == 300


def test_eight_shapes_at_most_and_the_rarest_goes():
    rng, bank = random.Random(9), Bank(4)
    first = wave(0, rng)
    for _ in range(5):
        bank.take(first)
    fresh = [bank.take(np.array([rng.gauss(0, 50) for _ in range(100)]))[3] for _ in range(40)]
    assert len(bank.shapes) == templates.MOST and sum(fresh) > 8 and bank.named == 1 + sum(fresh)
    assert bank.take(first)[0] == 0  # the common shape is still there


def test_close_shapes_become_one():
    rng = random.Random(2)
    base = wave(0, rng, noise=0)
    bank = Bank(4, [templates.Shape(0, base + wave(2, rng, noise=0) * 0.02, 5, 3), templates.Shape(4, base.copy(), 9, 1), templates.Shape(5, wave(1, rng, noise=0), 2, 0)], named=6)
    assert bank.take(base)[::4] == (0, 4)
    assert [(s.name, s.count) for s in bank.shapes] == [(0, 15), (5, 2)]
    steady = Bank(4, [templates.Shape(0, base + wave(2, rng, noise=0) * 0.3, 9, 3, [0.1] * 8), templates.Shape(1, base.copy(), 9, 1)], named=2)
    assert steady.take(base)[4] is None or len(steady.shapes) == 1


SCHEMA = "record string, t long, ts timestamp, points array<double>"


def test_stream_equals_table_over_batches_out_of_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"r{k}", t, wave(rng.randrange(3), rng, n=40).tolist()) for k in range(3) for t in range(60)]
    files = [[] for _ in range(5)]
    for row in rows:  # up to twelve seconds late
        files[min(4, (row[1] + rng.randint(0, 11)) // 14)].append(row)
    for k, part in enumerate(files):
        rng.shuffle(part)
        table = spark.createDataFrame(part, "record string, t long, points array<double>")
        table.select("record", "t", F.timestamp_seconds(1_700_000_000 + F.col("t")).alias("ts"), "points").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    late = [("end", 500, None), ("r0", 3, rows[0][2])]  # nulls are no beats; the second is behind the watermark by then
    for k, row in enumerate(late):
        one = spark.createDataFrame([row], "record string, t long, points array<double>")
        one.select("record", "t", F.timestamp_seconds(1_700_000_000 + F.col("t")).alias("ts"), "points").coalesce(1).write.parquet(f"{tmp_path}/in/{5 + k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet").withWatermark("ts", "20 seconds")
    found = runs.settled(templates.match_stream(stream, expire_ms=1_000_000), "shapes-test")
    whole = spark.createDataFrame(rows, "record string, t long, points array<double>")
    wanted = templates.match(whole)
    plain = lambda df: sorted((r["record"], r["t"], r["shape"], round(r["metric"], 9), r["shift"], r["is_new"], r["combined"]) for r in df.collect())
    assert plain(found) == plain(wanted) and len(plain(found)) == 180


def test_edge_cases_of_the_table(spark):
    rows = [("a", 1, [1.0, 5.0, 1.0, 2.0] * 5), ("a", None, [1.0] * 20), (None, 1, [1.0] * 20), ("b", 1, None), ("c", 1, [2.0] * 20), ("c", 2, [2.0] * 20)]
    found = templates.match(spark.createDataFrame(rows, "record string, t long, points array<double>"), shift=2)
    assert sorted((r["record"], r["t"], r["shape"], r["is_new"]) for r in found.collect()) == [("a", 1, 0, True), ("c", 1, 0, True), ("c", 2, 1, True)]
    assert templates.match(found.select("record", "t", F.array("metric").alias("points")).limit(0)).count() == 0
