import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import labels as L
from pulsegrid.operators import spans as S
from pulsegrid.streaming import beats


def found(spark, rows, n=40):
    notes = [("r", t, k, c, s, a) for k, (t, c, s, a) in enumerate(rows)]
    df = spark.createDataFrame(notes, "record string, t long, seq long, code string, sub_type int, aux string")
    out = S.spans(df, spark.createDataFrame([("r", n)], "record string, n long"))
    return sorted((r.begin, r.end, r.rhythm) for r in out.collect())


@pytest.mark.parametrize(
    "rows,spans",
    [
        ([(0, "+", 0, "(VF"), (10, "~", 1, None), (20, "~", 0, None)], [(0, 10, "(VF"), (20, 40, "(VF")]),
        ([(0, "+", 0, "(N"), (10, "~", 0, None)], [(0, 10, "(N"), (10, 40, "(N")]),
        ([(5, "[", 0, None), (15, "]", 0, None)], [(5, 15, "(VF")]),
        ([(0, "+", 0, "(N"), (10, "|", 0, None), (12, "N", 0, None)], [(0, 10, "(N")]),
        ([(0, "+", 0, "(NOISE"), (10, "+", 0, "(N")], [(10, 40, "(N")]),
        ([(0, "+", 0, "(N"), (5, "+", 0, "(NOISE"), (9, "~", 0, None)], [(0, 5, "(N")]),
        ([(0, "+", 0, "(N"), (0, "+", 0, "(VT")], [(0, 40, "(VT")]),
        ([], []),
    ],
)
def test_corner_cases(spark, rows, spans):
    assert found(spark, rows) == spans


def test_exact_fit_is_dropped(spark):
    spans = spark.createDataFrame([("r", "(N", 0, 16), ("r", "(N", 20, 53), ("r", "(N", 60, 62)], "record string, rhythm string, begin long, end long")
    cut = [(r.begin, r.end) for r in S.segments(spans, 8).orderBy("begin").collect()]
    assert cut == [(0, 8), (20, 28), (28, 36), (36, 44), (44, 52)]


def test_risk_limits(spark):
    rows = [("(VF", 0.2, 0.0, 2), ("(VF", 0.21, 0.0, 1), ("(VT", 1.0, 180.0, 1), ("(VT", 1.0, 172.5, 2), ("(VT", 1.0, 0.0, 2), ("(VFL", 1.0, 0.0, 1), ("(N", 1.0, 200.0, 0)]
    df = spark.createDataFrame(rows, "rhythm string, amplitude double, rate double, risk int")
    assert df.where(L.risk_class(F.col("rhythm"), F.col("amplitude"), F.col("rate")) != F.col("risk")).count() == 0
    assert [r[0] for r in df.select(L.canonical(F.lit("(VFIB"))).limit(1).collect()] == ["(VF"]


def test_stream_finds_the_beats_of_the_table(spark, tmp_path):
    from pulsegrid.sources.shared import ship
    from pulsegrid.streaming.runs import settled

    ship(spark)
    rows = [(r, t, (8.0 if t % 37 == r else 0.0) + ((t * 7919 + r) % 13) / 50) for r in (1, 2) for t in range(600)]
    df = spark.createDataFrame(rows, "record long, t long, value double")
    for k, (a, b) in enumerate(((0, 200), (200, 210), (210, 600))):
        df.where(f"t >= {a} and t < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = sorted(map(tuple, beats.detect(df, 36).collect()))
    assert 28 <= len(table) <= 34
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert sorted(map(tuple, settled(beats.detect_stream(stream, 36), "beats").collect())) == table
