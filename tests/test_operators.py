import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import dims, evaluation, graph, matching, stats, store
from pulsegrid.operators.beat_merge import merge_beats


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_merge_is_one_to_one_and_in_window(spark):
    rng = random.Random(2)
    ref = [(r, round(rng.uniform(0, 100), 2), rng.choice("NV")) for r in (1, 2) for _ in range(60)]
    test = [(r, t + rng.uniform(-0.5, 0.5), c) for r, t, c in ref if rng.random() < 0.8] + [(3, 5.0, "N")]
    a, b = frame(spark, ref, "record long, t double, code string"), frame(spark, test, "record long, t double, code string")
    pairs = merge_beats(a, b, 0.4).collect()
    assert sorted((p.record, p.t_ref) for p in pairs if p.t_ref is not None) == sorted((r, t) for r, t, _ in ref)
    assert sorted((p.record, p.t_test) for p in pairs if p.t_test is not None) == sorted((r, t) for r, t, _ in test)
    assert all(abs(p.t_ref - p.t_test) <= 0.4 for p in pairs if p.t_ref is not None and p.t_test is not None)
    assert all((p.ref == "O") == (p.t_ref is None) and (p.test == "O") == (p.t_test is None) for p in pairs)
    near = matching.nearest_beats(a, b, 0.4).collect()
    for p in near:
        assert abs(p.t_ref - p.t_test) == min(abs(t - p.t_ref) for r, t, _ in test if r == p.record)


def test_epochs_by_hand(spark):
    x = list(map(float, range(1000)))
    chunks = frame(spark, [("s", k, x[k * 64 : k * 64 + 64]) for k in range(16)], "src string, chunk long, samples array<double>")
    events = frame(spark, [(1, "s", 80), (2, "s", 140), (3, "s", 270), (4, "s", 5), (5, "s", 990), (6, "gone", 80)], "event_id long, src string, eoffset long")
    got = {r.event_id: r.samples for r in matching.epochs(events, chunks, 20, 81, 64).collect()}
    assert got == {1: x[60:161], 2: x[120:221], 3: x[250:351]}


def test_intervals_and_upsert(spark):
    points = frame(spark, [("r", float(t)) for t in range(20)] + [("q", 3.0)], "record string, t double")
    spans = frame(spark, [("r", 2.5, 4.0), ("r", 3.0, 9.0), ("r", 15.0, 15.0)], "record string, begin double, end double")
    assert sorted(r.t for r in matching.in_intervals(points, spans, 2.0).collect()) == [3, 4, 5, 6, 7, 8, 9, 15]
    old = frame(spark, [(1, 1.0, 5.0), (2, 2.0, 6.0)], "k long, a double, b double")
    new = frame(spark, [(2, 9.0), (3, 7.0)], "k long, b double")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [(1, 1.0, 5.0), (2, 2.0, 9.0), (3, None, 7.0)]


def test_dims(spark):
    df = frame(spark, [(1, 2, 3.0), (1, 3, float("nan")), (2, 2, 5.0)], "x long, y long, v double")
    r = dims.reduce(df, ["x"], "v", "y").orderBy("x").collect()
    assert (r[0].n, r[0]["max"], r[0].argmax) == (1, 3.0, 2)
    with pytest.raises(ValueError):
        dims.extend(df, df.drop("v"))
    with pytest.raises(ValueError):
        dims.add_dim(df, "x", [1])
    assert dims.select(df, "x > 1", ["x", "y"]).count() == 1
    with pytest.raises(Exception, match="v"):
        dims.select(df, "v > 1", ["x", "y"])


def test_ratios_and_scores(spark):
    df = frame(spark, [(1, 1), (1, 0), (0, 0)], "truth int, predicted int")
    r = evaluation.binary(df).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.se, r.sp, r.ppv, r.acc) == (1, 1, 1, 0, 0.5, 1.0, 1.0, 0.666667)
    empty = evaluation.binary(df.limit(0)).first()
    assert empty.tp == 0 and empty.se == 0.0


def test_graph_and_ranks(spark):
    nodes = frame(spark, [(i,) for i in (1, 2, 3, 10, 11, 20)], "node long")
    edges = frame(spark, [(3, 2), (2, 1), (11, 10), (20, 21), (3, 99)], "src long, dst long")
    assert {r.node: r.cluster for r in graph.clusters(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20}
    df = frame(spark, [("g", v) for v in (1.0, 2.0, 2.0, 5.0)], "g string, v double")
    assert sorted(r[0] for r in df.select(stats.average_rank("v", "g")).collect()) == [1, 2.5, 2.5, 4]


def test_constant_and_short_series(spark):
    df = frame(spark, [([1.0] * 16,), ([0.0] * 16,)], "x array<double>")
    row = df.select(A.phase_space(F.col("x"), 2), A.mean_absolute_value(F.col("x"), 4), A.petrosian(F.col("x")), A.hjorth(F.col("x")), A.permutation_entropy(F.col("x")))
    assert len(row.collect()) == 2


def test_student_p_and_z(spark):
    """Against numbers from tables."""
    from statistics import NormalDist

    from pulsegrid.operators import stats

    rows = [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (-2.228139, 10, 0.05), (1.959966, 10**6, 0.05), (0.0, 5, 1.0), (3.169273, 10, 0.01), (1.281552, 10**6, 0.2)]
    df = spark.createDataFrame(rows, "t double, df long, p double")
    for r in df.select("t", "p", stats.student_p(df.t, df.df).alias("mine"), stats.t_to_z(df.t, df.df).alias("z")).collect():
        assert abs(r.mine - r.p) < 2e-6
        assert r.t == 0 or abs(abs(r.z) - NormalDist().inv_cdf(1 - r.p / 2)) < 1e-5 and (r.z > 0) == (r.t > 0)
    for q in (1e-6, 0.01, 0.3, 0.5, 0.8, 0.999):
        assert abs(spark.range(1).select(stats.normal_quantile(F.lit(q)).alias("z")).first().z - NormalDist().inv_cdf(q)) < 1e-6


def test_labelled_array_places_and_fields(spark):
    from pulsegrid.operators import dims

    rows = [(a, b, 10.0 * a + b) for a in (1, 3, 5, 7) for b in (2, 4, 6)]
    df = spark.createDataFrame(rows, "a int, b int, v double").repartition(3)
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(dims.index(df, a=1)) == [(2, 32.0), (4, 34.0), (6, 36.0)]
    assert got(dims.index(df, a=-1, b=0)) == [(72.0,)]
    assert got(dims.index(df, a=slice(None, None, -2), b=[2])) == [(3, 6, 36.0), (7, 6, 76.0)]
    for bad in (4, -5, [0, 9]):
        with pytest.raises(IndexError):
            dims.index(df, a=bad)
    assert got(dims.diagonal(df, "a", "b").select("diagonal", "v")) == [(0, 12.0), (1, 34.0), (2, 56.0)]
    assert dims.new_axis(dims.new_axis(df)).columns[-2:] == ["newaxis_0", "newaxis_1"]
    assert dims.squeeze(df.where("a = 3")).columns == ["b", "v"]
    assert {r.bin for r in dims.split_bins(df, "a", [1, 3]).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        dims.add_fields(df, v="int")
    with pytest.raises(ValueError):
        dims.remove_fields(df, "w")
    assert dims.reduce(df, ["a"], "v", "b").where("a = 1").first()["prod"] == 12.0 * 14 * 16


def test_text_reports_and_pulse_logs(spark, tmp_path):
    from pulsegrid.sources import reports

    df = spark.createDataFrame([("x", 1, 0.5), ("y, z", None, 2.0)], "name string, n long, share double")
    reports.write(df, f"{tmp_path}/out")
    reports.write(df.where("n = 1"), f"{tmp_path}/out", append=True)
    assert sorted(map(str, reports.read(spark, f"{tmp_path}/out", df.schema).collect())) == sorted(map(str, [*df.collect(), *df.where("n = 1").collect()]))
    (tmp_path / "log.txt").write_text("100\t1\tUP\nbad\t1\tUP\n250\t2\tDOWN\n300\t1\tUP\n")
    assert sorted((r.t for r in reports.pulses(spark, f"{tmp_path}/log.txt", "UP").collect()), key=str) == [100, 300, None]


def test_shapes_of_arrays(spark):
    rows = [(f"x{i}", j * 10, float(i * 6 + j)) for i in range(4) for j in range(6)]
    df = frame(spark, rows, "one string, two long, v double").repartition(5)
    flat = dims.flattened(df, ["one", "two"]).collect()
    assert all(r.place == r.v for r in flat)
    cube = dims.reshaped(df, ["one", "two"], {"a": 2, "b": -1, "c": 4}).collect()
    assert sorted((r.a, r.b, r.c, r.v) for r in cube) == [(k // 12, k // 4 % 3, k % 4, float(k)) for k in range(24)]
    for shape in ({"a": 5, "b": 5}, {"a": -1, "b": -1}, {"a": -1, "b": 7}):
        with pytest.raises(ValueError):
            dims.reshaped(df, ["one", "two"], shape)
    swapped = dims.swapped(df, "one", "two")
    assert {(r.two, r.one, r.v) for r in swapped.collect()} == set(rows) and swapped.columns == df.columns
    assert sorted({r.two for r in dims.compressed(df, "two", [True, False, True]).collect()}) == [0, 20]


def test_muscle_noise_by_hand(spark):
    x = [0] * 100
    x[38:43] = [20, 80, 200, 80, 20]
    x[20], x[60] = 9, -7
    rough = [abs(x[i] - 2 * x[i - 1] + x[i - 2]) for i in range(12, 68)]
    sums = {12 + k: sum(rough[max(0, k - 4) : k + 1]) for k in range(56)}
    want = max(v for i, v in sums.items() if i < 35 or i > 51) * 10 // (200 // 4)
    df = frame(spark, [(x,), ([1] * 100,)], "x array<long>")
    assert [r.n for r in df.select(A.muscle_noise(F.col("x"), 40).alias("n")).collect()] == [want, 0]


def test_wide_logs_and_average_rows(spark):
    from pulsegrid.sources import reports

    log = frame(spark, [(1, "a", 0), (1, "b", 2), (2, "b", None)], "sample long, run string, p int")
    wide = reports.wide(log, ["sample"], "run", "p", ["a", "b", "c"])
    assert sorted(map(tuple, wide.collect())) == [(1, "0", "2", "N/A"), (2, "N/A", "N/A", "N/A")]
    rows = frame(spark, [(1, 2.0, "x"), (2, 4.0, "y")], "k long, v double, note string")
    assert sorted(map(tuple, reports.with_average(rows, "k", ["v"]).collect())) == [("1", 2.0, "x"), ("2", 4.0, "y"), ("average", 3.0, None)]
    assert [tuple(r) for r in reports.with_average(rows.limit(0), "k", ["v"]).collect()] == [("average", None, None)]


def test_seconds_are_summed_in_the_order_of_samples(spark, tmp_path):
    """The mean less the deviation is 7.18 to the last bit only if summed in order."""
    from pulsegrid.plans import signal

    values = [52.96, 27.32, 7.18, 15.31, 11.43, 102.06, 48.12, 102.43]
    rows = [(k, 1, k, v) for k, v in reversed(list(enumerate(values)))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, value double").selectExpr("event_id", "user_id", "timestamp_seconds(at) AS ts", "value")
    plan = signal.per_second_counts
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    total = mid = dev = 0.0
    for v in values:
        total += v
    mid = total / 8
    for v in values:
        dev += abs(v - mid)
    dev /= 8
    found = plan(spark, str(tmp_path)).first()
    assert found.count3 == sum(mid - dev <= v <= mid + dev for v in values) and found.count2 == 4
    assert "t#" in plan(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString().split("AS mid")[0].split("avg(")[-1]


def test_copies_of_shuffles_do_not_move(spark, monkeypatch):
    """Rows are dealt once, by group, before they are copied; groups over the bound give the same."""
    df = spark.createDataFrame([(i % 7 if i % 3 else 9, i) for i in range(300)], "g long, v long")
    key = F.struct((F.col("v") * (2 * F.col("perm") + 1)) % 101, "v")
    plain = stats.permuted(df, key, 5, "g")
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "perm#" not in plan[plan.index("Exchange") :]
    monkeypatch.setattr(stats, "GROUP_ROWS", 60)
    places = lambda d: sorted(map(tuple, d.select("g", "v", "perm", "place").collect()))
    assert places(plain) == places(stats.permuted(df, key, 5, "g"))
    groups = {}
    for g, v, perm, place in places(plain):
        groups.setdefault((g, perm), []).append((place, (v * (2 * perm + 1)) % 101, v))
    assert all([p for p, *_ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x) == sorted(x, key=lambda r: r[1:]) for x in groups.values())
