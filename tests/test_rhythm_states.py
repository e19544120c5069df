"""Rhythm states against a walk that keeps all eight intervals and types."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import rhythm_states as R
from pulsegrid.operators import scan


def match(a, b):
    return abs(a - b) < (a + b) // 8


def short(a, b):
    return a < b - b // 4


def early(w, ty):
    normal = [k for k in range(1, 7) if ty[k] == "NN"]
    if len(normal) < 4:
        return False
    mean = sum(w[k] for k in normal[:4]) // 4
    return all(abs(mean - w[k]) <= mean // 16 for k in normal) and w[0] < mean - mean // 8


def walk(rrs, brady):
    """(kind, class, bigeminy) interval by interval."""
    w, ty, out = [0] * 9, ["QQ"] * 9, []
    for i, rr in enumerate(rrs):
        w, ty, flag = [rr, *w[:8]], ["QQ", *ty[:8]], False
        if i < 3:
            kind, group = "QQ", "Q"
        elif ty[1] == "QQ":
            flag = all(match(w[k], w[k + 2]) and not match(w[k], w[k + 1]) for k in range(6))
            if all(match(w[k], w[k + 1]) for k in range(3)):
                kind, group, flag = "NN", "N", False
            elif flag:
                kind, group, ty[1] = ("NV", "V", "VN") if w[0] < w[1] else ("VN", "N", "NV")
            elif short(w[0], w[1]) and match(w[1], w[2]) and match(2 * w[2], w[3] + w[4]) and match(w[4], w[0]) and match(w[5], w[2]):
                kind, group, ty[1] = "NV", "V", "NN"
            else:
                kind, group = "QQ", "Q"
        elif ty[1] == "NN":
            if early(w, ty):
                kind, group = ("NV", "V") if w[1] < brady else ("QQ", "Q")
            elif match(w[0], w[1]):
                kind, group = "NN", "N"
            elif short(w[0], w[1]):
                known = match(w[0], w[2]) and ty[2] == "NN"
                kind, group = ("NN", "N") if known else ("NV", "V") if w[1] < brady else ("QQ", "Q")
            else:
                kind, group = "QQ", "N"
        elif ty[1] == "NV":
            if early(w[1:], ty[1:]):
                if match(w[0], w[1]):
                    kind, group, ty[1] = "NN", "N", "NN"
                else:
                    kind, group = ("VN", "N") if w[0] > w[1] else ("QQ", "Q")
            elif match(w[0], w[1]):
                kind, group = "VV", "V"
            else:
                kind, group = ("VN", "N") if w[0] > w[1] else ("QQ", "Q")
        elif ty[1] == "VN":
            nn = next((w[k] for k in range(2, 8) if ty[k] == "NN"), 0)
            nv = next((w[k] for k in range(2, 8) if ty[k] == "NV"), 0)
            if nn and match(w[0], nn):
                kind, group = "NN", "N"
            else:
                nn = (w[1] + nv) // 2 if not nn and nv else nn
                if nv and abs(nn - w[0]) < abs(nv - w[0]) and match(nn, w[0]):
                    kind, group = "NN", "N"
                elif nv and abs(nn - w[0]) > abs(nv - w[0]) and match(nv, w[0]):
                    kind, group = "NV", "V"
                else:
                    kind, group = "QQ", "Q"
        else:
            kind, group = ("VV", "V") if match(w[0], w[1]) else ("QQ", "Q") if short(w[0], w[1]) else ("VN", "N")
        ty[0] = kind
        out.append((kind, group, flag))
    return out


def series(rng, n):
    """Stretches of regular, paired, early, slow and random beats."""
    out = []
    while len(out) < n:
        base, kind, long = rng.choice([80, 100, 160, 320]), rng.randrange(6), rng.randint(4, 14)
        jitter = lambda x: x + rng.randint(-3, 3)
        out += {
            0: [jitter(base) for _ in range(long)], 1: [jitter(base if k % 2 else base * 2 // 3) for k in range(long)], 2: [*([base] * 5), base * 6 // 10, base * 14 // 10, base],
            3: [base, base, base, base // 2, base // 2, base // 2, base], 4: [rng.randint(40, 400) for _ in range(long)], 5: [base, base, base * 7 // 10, base * 13 // 10, base] * 2,
        }[kind]
    return out[:n]


def rows_of(found):
    out = {}
    for r in found.orderBy("record", "i").collect():
        out.setdefault(r["record"], []).append((r["kind"], r["class"], r["bigeminy"]))
    return out


@pytest.mark.parametrize("size,fan", [(8, 2), (16, 256), (4096, 256)])
def test_chunks_give_what_one_pass_gives(spark, monkeypatch, size, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(size)
    records = {k: series(rng, n) for k, n in enumerate([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40, 200, 333])}
    table = spark.createDataFrame([(k, i, rr) for k, rrs in records.items() for i, rr in enumerate(rrs)] + [(None, 0, 80)], "record long, i long, rr long").repartition(5)
    found = rows_of(R.rhythm_states(table, 250, size))
    wanted = {k: walk(rrs, 250) for k, rrs in records.items()}
    assert found == wanted
    assert {k for rows in wanted.values() for k, _, _ in rows} == set(R.KINDS) and any(f for rows in wanted.values() for _, _, f in rows)


def test_names_of_records_and_empty_tables(spark):
    table = spark.createDataFrame([("a", i, 100) for i in range(9)], "record string, i long, rr long")
    assert rows_of(R.rhythm_states(table, 250)) == {"a": walk([100] * 9, 250)}
    assert R.rhythm_states(table.limit(0), 250).count() == 0
    with pytest.raises(ValueError):
        R.rhythm_states(table, 250, size=4)


def test_one_record_over_many_tasks(spark):
    """A million intervals of one record: no task reads them all."""
    n = 1_000_000
    rr = F.when(F.col("i") % 7 == 3, 60).when(F.col("i") % 7 == 4, 140).otherwise(100 + F.col("i") % 3)
    table = spark.range(0, n, 1, 8).select(F.lit(1).cast("long").alias("record"), F.col("id").alias("i")).withColumn("rr", rr.cast("long"))
    began = time.time()
    found = R.rhythm_states(table, 250)
    got = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    short = walk([int(r) for r in np.where(np.arange(7000) % 7 == 3, 60, np.where(np.arange(7000) % 7 == 4, 140, 100 + np.arange(7000) % 3))], 250)
    share = sum(k == "NV" for k, _, _ in short) / 7000
    assert sum(got.values()) == n and abs(got["NV"] / n - share) < 0.001
    sizes = R._chunks(table, R.SIZE).agg(F.max(F.size("rr")), F.count("*")).first()
    assert sizes[0] <= R.SIZE + 7 and sizes[1] == -(-n // R.SIZE) and time.time() - began < 300


def test_places_count_within_groups(spark):
    rows = [(k, i * 3 % 50) for k in ("a", "b", None) for i in range(50)]
    found = scan.placed(spark.createDataFrame(rows, "g string, t int").repartition(7), "g", "t").collect()
    assert sorted((str(r["g"]), r["t"], r["i"]) for r in found) == sorted((str(k), t, t) for k, t in rows)


def test_short_records_need_no_map(spark, monkeypatch):
    """The entry state of a record's first chunk is known, so only longer records have maps."""
    import random

    rng = random.Random(9)
    rows = [(r, i, rng.choice([100, 200, 300])) for r in range(5) for i in range(50)]
    table = spark.createDataFrame(rows, "record int, i long, rr long")
    assert R._chunks(table, 16).where("chunk > 0").count() == 0
    seen = []
    monkeypatch.setattr(R, "entries", lambda maps, first: seen.append(maps.count()) or maps.select("record", "chunk", F.lit(first).alias("entry")))
    assert R.rhythm_states(table, 300, size=16).count() == 250 and seen == [0]
