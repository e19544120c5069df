"""Joins in time: beats against beats, intervals, epochs around events, series against series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def nearest_beats(ref: DataFrame, test: DataFrame, window: float) -> DataFrame:
    """Pairs of beats that are each other's nearest within the window: (record, t_ref,
    t_test), from (record, t, code). Cells of the window's width make it an equality join,
    and two ranks choose; of equally near beats the earlier is taken."""
    near = F.explode(F.array(F.floor(F.col("t_ref") / window) - 1, F.floor(F.col("t_ref") / window), F.floor(F.col("t_ref") / window) + 1))
    left = ref.select("record", F.col("t").alias("t_ref"), F.col("code").alias("ref")).withColumn("cell", near)
    right = test.select("record", F.col("t").alias("t_test"), F.col("code").alias("test")).withColumn("cell", F.floor(F.col("t_test") / window))
    both = left.join(right, ["record", "cell"]).withColumn("far", F.abs(F.col("t_ref") - F.col("t_test"))).where(F.col("far") <= window)
    both = both.withColumn("a", F.row_number().over(W.partitionBy("record", "t_ref").orderBy("far", "t_test")))
    both = both.withColumn("b", F.row_number().over(W.partitionBy("record", "t_test").orderBy("far", "t_ref")))
    return both.where("a = 1 and b = 1").select("record", "ref", "test", "t_ref", "t_test")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("ref", "test").agg(F.count("*").alias("n"))


def beat_summary(pairs: DataFrame) -> DataFrame:
    """Sensitivity and positive predictivity of beats and of ventricular beats."""
    real, found = ~F.col("ref").isin("O", "X"), ~F.col("test").isin("O", "X")
    v_ref, v_test = F.col("ref") == "V", F.col("test") == "V"
    part = lambda a, b: F.try_divide(F.count_if(a & b), F.count_if(b))
    return pairs.groupBy("record").agg(
        part(found, real).alias("se"), part(real, found).alias("ppv"), part(v_test, v_ref).alias("v_se"), part(v_ref, v_test).alias("v_ppv")
    )


def in_intervals(points: DataFrame, intervals: DataFrame, size: float) -> DataFrame:
    """Points (record, t, ...) that an interval [begin, end] of their record holds; cells of
    `size` make it an equality join."""
    cells = F.sequence(F.floor(F.col("begin") / size), F.floor(F.col("end") / size))
    dealt = intervals.withColumn("cell", F.explode(cells)).select("record", "cell", "begin", "end").distinct()
    placed = points.withColumn("cell", F.floor(F.col("t") / size))
    hit = (placed["record"] == dealt["record"]) & (placed["cell"] == dealt["cell"]) & (placed["t"] >= dealt["begin"]) & (placed["t"] <= dealt["end"])
    return placed.join(dealt, hit, "left_semi").drop("cell")


def epochs(events: DataFrame, chunks: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """(event_id, samples): samples [offset - before, offset + after) of each event's source.

    chunks has (src, chunk, samples), each of `size` samples but the last of a source. Only
    the chunks that an epoch meets are joined; ones that leave the source are dropped.
    """
    span = events.where(F.col("eoffset") >= before).withColumn("start", F.col("eoffset") - before).withColumn("stop", F.col("eoffset") + after)
    wanted = span.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    met = wanted.join(chunks, ["src", "chunk"])
    first = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0))
    last = F.least(F.col("stop") - F.col("chunk") * size, F.size("samples").cast("long"))
    piece = met.where(last > first).select("event_id", "chunk", F.slice("samples", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    whole = piece.groupBy("event_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda c: c["part"])).alias("samples"))
    return whole.where(F.size("samples") == before + after)


def aligned(pulses: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """(record, slope, intercept, n) of the line from one clock of a record to its other:
    pulses (record, t) of both are matched where their intervals to the next pulse agree
    within the tolerance, and no other interval of the record agrees with either."""
    w = W.partitionBy("record").orderBy("t")

    def gaps(df: DataFrame, name: str) -> DataFrame:
        found = df.select("record", F.col("t").alias(name), (F.lead("t").over(w) - F.col("t")).alias(f"gap_{name}"))
        return found.where(f"gap_{name} is not null")

    cell = lambda c, d=0: F.floor(F.col(c) / tolerance) + d
    a = gaps(pulses, "a").withColumn("cell", F.explode(F.array(cell("gap_a", -1), cell("gap_a"), cell("gap_a", 1))))
    both = a.join(gaps(other, "b").withColumn("cell", cell("gap_b")), ["record", "cell"]).where(F.abs(F.col("gap_a") - F.col("gap_b")) <= tolerance)
    alone = both.withColumn("n", F.count("*").over(W.partitionBy("record", "a"))).withColumn("m", F.count("*").over(W.partitionBy("record", "b")))
    alone = alone.where("n = 1 and m = 1")
    return alone.groupBy("record").agg(F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.count("*").alias("n"))


def on_source(events: DataFrame, lines: DataFrame, rate: float, lengths: DataFrame) -> DataFrame:
    """events (record, t, ...) with eoffset, their place in samples on the record's other clock,
    by the lines of aligned(). Events off the source (lengths: record, n samples) are left out,
    and those of a record without a line."""
    known = lines.select("record", "slope", "intercept").join(lengths, "record")
    placed = events.join(known, "record").withColumn("eoffset", (F.col("slope") * F.col("t") + F.col("intercept")) * rate)
    return placed.where("eoffset >= 0 and eoffset < n").drop("slope", "intercept", "n")
