"""Merging by chunks against one walk over each whole record."""

import random

import pytest

from pulsegrid.operators import scan
from pulsegrid.operators.beat_merge import merge_beats, with_pauses

BEAT = "record string, t double, code string"


def whole(ref, test, window):
    """Pairs of one record by a walk over both sorted lists."""
    ref, test, out, i, j = sorted(ref), sorted(test), [], 0, 0
    while i < len(ref) or j < len(test):
        a = ref[i][0] if i < len(ref) else float("inf")
        b = test[j][0] if j < len(test) else float("inf")
        if b < a:
            nxt = test[j + 1][0] if j + 1 < len(test) else float("inf")
            hit = a - b <= window and a - b < abs(a - nxt)
        else:
            nxt = ref[i + 1][0] if i + 1 < len(ref) else float("inf")
            hit = b - a <= window and b - a < abs(b - nxt)
        left, right = hit or a <= b, hit or b < a
        out.append((ref[i][1] if left else "O", test[j][1] if right else "O", a if left else None, b if right else None))
        i, j = i + left, j + right
    return out


@pytest.mark.parametrize("chunk,fan,gap", [(2, 2, 0.3), (3, 256, 0.9), (512, 256, 0.3)])
def test_chunks_give_what_whole_records_give(spark, monkeypatch, chunk, fan, gap):
    """With beats denser than the window, pairs straddle most cuts."""
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(chunk)
    ref, test = [], []
    for k in range(12):
        at = rng.uniform(-50, 50)
        for _ in range(rng.choice([0, 1, 5, 80])):
            at += rng.choice([0, rng.uniform(0, gap), rng.uniform(0, 3), 20 if rng.random() < 0.05 else 0.1])
            ref.append((str(k), round(at, 2), rng.choice("NV")))
            if rng.random() < 0.8:
                test.append((str(k), round(at + rng.uniform(-0.6, 0.6), 2), rng.choice("NVS")))
        test += [(str(k), round(rng.uniform(-50, 50), 2), "N") for _ in range(5)]
    ref.append((None, 1.0, "N"))
    found = merge_beats(spark.createDataFrame(ref, BEAT).repartition(4), spark.createDataFrame(test, BEAT), 0.5, chunk).collect()
    wanted = [(k, *row) for k in {r[0] for r in [*ref, *test] if r[0]} for row in whole([r[1:] for r in ref if r[0] == k], [r[1:] for r in test if r[0] == k], 0.5)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert any(r["t_ref"] is not None and r["t_test"] is not None for r in found)


def test_empty_streams(spark):
    none = spark.createDataFrame([], BEAT)
    one = spark.createDataFrame([("a", 1.0, "N"), ("a", None, "N")], BEAT)
    assert merge_beats(none, none, 0.5).count() == 0
    assert [tuple(r) for r in merge_beats(one, none, 0.5).collect()] == [("a", "N", "O", 1.0, None)]
    assert [tuple(r) for r in merge_beats(none, one, 0.5).collect()] == [("a", "O", "N", None, 1.0)]


def test_long_record(spark):
    """400,000 beats of one record, an interval of 0.8 and a window of 0.15."""
    n = 400_000
    ref = spark.range(n).selectExpr("7L AS record", "id * 0.8D AS t", "'N' AS code")
    test = spark.range(n).where("id % 10 <> 3").selectExpr("7L AS record", "id * 0.8D + (id % 5) * 0.05D - 0.1D AS t", "'N' AS code")
    found = merge_beats(ref, test, 0.15).groupBy("ref", "test").count().collect()
    assert {(r["ref"], r["test"]): r["count"] for r in found} == {("N", "N"): n * 9 // 10, ("N", "O"): n // 10}


def test_pauses(spark):
    pairs = [("a", "N", "N", 1.0, 1.1), ("a", "N", "O", 2.0, None), ("a", "N", "O", 9.0, None), ("a", "O", "V", None, 3.0), ("a", "O", "V", None, 6.0), ("a", "O", "V", None, 7.0), ("b", "O", "V", None, 3.0)]
    table = spark.createDataFrame(pairs, "record string, ref string, test string, t_ref double, t_test double")
    spans = lambda *rows: spark.createDataFrame(list(rows), "record string, begin double, end double")
    found = with_pauses(table, 2.0, ref_off=spans(("a", 2.5, 3.0), ("a", 0.0, 6.5)), test_off=spans(("a", 0.0, 5.0)), flutter=spans(("a", 5.5, 6.2)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("a", "N", "N", 1.0, 1.1), ("a", "N", "X", 2.0, None), ("a", "N", "O", 9.0, None), ("a", "X", "V", None, 3.0), ("a", "O", "V", None, 7.0), ("b", "O", "V", None, 3.0)], key=str
    )
