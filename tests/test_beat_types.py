"""Beat typing by hand; the registered queries hold it against SQL."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import beat_types as B
from pulsegrid.operators import scan

BEAT = "record string, i long, rr long, shape int, class string, width int, likeness double"


def dominant(beats, at):
    """The dominant shape as of beats[at], by counting."""
    last = [(k, b) for k, b in enumerate(beats[: at + 1]) if k > at - 180]
    shapes = [b["shape"] for _, b in last if b["shape"] is not None]
    normals = [b["shape"] for k, b in last if k and b["shape"] is not None and b["class"] == "N" and b["width"] < 13 and beats[k - 1]["shape"] == b["shape"]]
    top = lambda values: min(set(values), key=lambda v: (-values.count(v), v), default=None)
    best, most = top(normals), top(shapes)
    odd = sum(b["class"] == "Q" and b["shape"] is not None for _, b in last)
    doubtful = best is None or shapes.count(most) >= 2 * shapes.count(best) or shapes.count(best) >= 2 * normals.count(best)
    return (most if doubtful else best), odd <= 60


def made_up(rng, n):
    return [
        {"i": i, "rr": rng.choice([100, 100, 70, 130]), "shape": rng.choice([0, 0, 0, 0, 1, 2, None]), "class": rng.choice("NNNVQQQ"), "width": rng.choice([8, 10, 14]), "likeness": rng.uniform(0, 4)}
        for i in range(n)
    ]


@pytest.mark.parametrize("size", [180, 200, 4096])
def test_dominant_across_chunks(spark, size):
    rng = random.Random(size)
    records = {k: made_up(rng, n) for k, n in (("a", 1), ("b", 420), ("c", 361))}
    table = spark.createDataFrame([(k, *b.values()) for k, rows in records.items() for b in rows], BEAT).repartition(3)
    found = {(r["record"], r["i"]): (r["dominant"], r["steady"]) for r in B.with_dominant(table, size).collect()}
    assert found == {(k, b["i"]): dominant(rows, b["i"]) for k, rows in records.items() for b in rows}
    assert {s for _, s in found.values()} == {True, False}


def test_automaton_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 3)
    rng = random.Random(1)
    table = [[rng.randrange(5) for _ in range(5)] for _ in range(3)]
    series = {k: [rng.randrange(3) for _ in range(n)] for k, n in enumerate([1, 7, 8, 9, 100])}
    rows = [(k, i, s) for k, v in series.items() for i, s in enumerate(v)] + [(None, 0, 1)]
    found = {(r["record"], r["i"]): r["state"] for r in scan.automaton(spark.createDataFrame(rows, "record long, i long, symbol int").repartition(4), table, 2, 4).collect()}
    wanted = {}
    for k, v in series.items():
        state = 2
        for i, s in enumerate(v):
            wanted[k, i], state = state, table[s][state]
    assert found == wanted


def test_premature_beat_with_a_pause_and_its_history(spark):
    """A beat of shape 1, early by half and with a pause behind, every fifth beat."""
    rows = []
    for i in range(60):
        odd = i % 5 == 4
        rows.append(("r", i, 50 if odd else 150 if i % 5 == 0 and i else 100, 1 if odd else 0, "V" if odd else "N", 10, 2.0 if odd else 0.2))
    beats = B.with_dominant(spark.createDataFrame(rows, BEAT))
    found = {r["i"]: r for r in B.second_thoughts(beats, 8).collect()}
    premature = [i for i in range(4, 59, 5)]
    assert [i for i, r in sorted(found.items()) if r["post_class"] == "V"] == premature
    assert [i for i in premature if found[i]["shape_class"] == "V"] == premature[2:] and all(found[i]["post_rhythm"] == "V" for i in premature)
    assert 59 not in found and 1 not in found


def test_first_rule_that_holds_decides(spark):
    names = {"class": "N", "width": 10, "dominant_width": 10, "dominant": 0, "dominant_even": False, "dominant_uneven": False, "likeness": 3.0, "steady": False, "shape": 0, "shapes": 3, "seen": 5,
             "post_rhythm": None, "muscle": 0, "motion": 0, "base": 0}
    cases = [({"dominant": None}, 1, "Q"), ({"width": 8}, 3, "N"), ({"shape": None}, 5, "N"), ({"likeness": 1.0}, 7, "N"), ({"steady": True}, 14, "N"), ({"class": "V", "steady": True}, 12, "V"),
             ({"class": "V", "steady": True, "dominant_even": True}, 2, "V"), ({"width": 16}, 11, "V"), ({"width": 16, "muscle": 50, "likeness": 3.6}, 15, "V"), ({"width": 16, "muscle": 80}, 19, "N"), ({}, 17, "N"),
             ({"width": 16, "muscle": 50}, 20, "V"), ({"likeness": 1.4, "post_rhythm": "N", "class": "Q"}, 8, "N"), ({"shapes": 8, "seen": 1, "class": "Q"}, 6, "N")]
    ddl = "k int, class string, width int, dominant_width int, dominant int, dominant_even boolean, dominant_uneven boolean, likeness double, steady boolean, shape int, shapes int, seen int, post_rhythm string, muscle int, motion int, base int"
    table = spark.createDataFrame([(k, *(names | change).values()) for k, (change, _, _) in enumerate(cases)], ddl)
    assert [(r["rule"], r["rule_class"]) for r in B.by_rules(table).orderBy("k").collect()] == [(n, c) for _, n, c in cases]


def test_empty_tables_and_small_chunks(spark):
    none = spark.createDataFrame([], BEAT)
    assert B.second_thoughts(B.with_dominant(none)).count() == 0
    with pytest.raises(ValueError):
        B.with_dominant(none, 100)
    assert scan.with_halo(spark.range(10).select(F.col("id").alias("i")), 2, 1, 4).where("not own").count() == 4 + 3


def test_features_take_the_beats_before_by_windows(spark):
    """No join by place: one sort in a task."""
    from pulsegrid.plans import beats as P

    plan = P.features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
