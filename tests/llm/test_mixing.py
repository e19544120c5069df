import hashlib
import math
from collections import Counter

import duckdb
import pytest

from pulsegrid.llm import mixing


def number(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def brute(rows, weights, seed):
    mass = Counter()
    for _, text, source in rows:
        mass[source] += len(text or "") + 1
    weight = {s: weights.get(s, 1.0) for s in mass}
    out = []
    for i, text, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(mass.values()) / mass[source]
        parts = max(1, math.ceil(rate / 16))
        count = 0
        for j in range(1, parts + 1):
            at, k, p, c = number(seed, "null" if i is None else i, j), 0, math.exp(-rate / parts), 0.0
            while k <= 100:
                c += p
                if c > at:
                    break
                k, p = k + 1, p * (rate / parts) / (k + 1)
            count += k
        out += [(i, text, source, n) for n in range(1, count + 1)]
    return sorted(out, key=str)


def table():
    rows = [(i, "x" * (i % 37), f"src{0 if i % 3 == 0 else i % 5}") for i in range(300)]
    rows += [(1000, "tiny", "rare"), (1001, None, None), (1002, "", None), (None, "no id", "src1"), (5, "x" * 5, "src0"), (5, "x" * 5, "src0")]
    return rows


@pytest.mark.parametrize("weights", [{"src0": 2.0}, {"rare": 3.0, "src1": 0.0, "gone": 5.0}])
def test_counts_are_the_inverse(spark, weights):
    rows = table()
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, source string, copy int, shuffle_key string")
    out = mixing.mix(df, weights)
    got = out.select("doc_id", "text", "source", "copy").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, weights, mixing.SEED)
    if "rare" in weights:  # a mean far over PART_MEAN is drawn in parts
        assert sum(r.doc_id == 1000 for r in got) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix(df.limit(0), weights).count() == 0


def test_order_is_a_shuffle_and_repeatable(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string, source string")
    a, b = (mixing.mix(df.repartition(n), {"src0": 2.0}).select("doc_id", "copy", "shuffle_key").collect() for n in (1, 4))
    assert sorted(map(str, a)) == sorted(map(str, b))
    keys = [r.shuffle_key for r in mixing.mix(df, {"src0": 2.0}).coalesce(1).collect()]
    assert len(set(keys)) >= len(keys) - 4


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"src0": 2.0}).select("doc_id", "text", "source", "copy").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, {"src0": 2.0}, mixing.SEED)


def test_sql_agrees(spark):
    rows = [(i, t, "en", s, 3) for i, t, s in table()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mine = mixing.mix(df, mixing.WEIGHTS).drop(mixing.RATE).toPandas()
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    theirs = con.sql(mixing.MIX_SQL).df()
    key = lambda f: sorted(zip(f["shuffle_key"], f["copy"].astype(int)))
    assert key(mine) == key(theirs)


def test_clashing_names_and_odd_weights(spark):
    rows = [(i, "t" * i, f"src{i % 2}", 1, 2, 3, 4, 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_parts int, mix_curve int, mix_count int, mix_source int, c0 int")
    out = mixing.mix(df, {"src0": 2.0})
    assert out.columns == [*df.columns, mixing.RATE, mixing.COPY, mixing.ORDER]
    wanted = brute([r[:3] for r in rows], {"src0": 2.0}, mixing.SEED)
    assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == sorted(w[:3] for w in wanted)
    assert {tuple(r)[3:8] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert mixing.mix(df, {"src0": 0.0, "src1": 0.0}).count() == 0
    assert {r.source for r in mixing.mix(df, {"src0": 0.0}).collect()} == {"src1"}
    with pytest.raises(ValueError):
        mixing.mix(df, {"src0": -1.0})
