"""Beat detection's filters and noise as windows over a record's samples.

Every recursive stage of the chain has a finite answer to an impulse, so each is a sum over
trailing samples; all stages share one sort of the record. Values are whole numbers, and
quotients drop their fraction, as the detector's do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lengths at 200 samples a second (fixed values): low pass, high pass, slope, integration.
LOW, HIGH, SLOPE, WIDE = 10, 25, 2, 16
MOST = 32000


def quotient(a: Column, n: int) -> Column:
    return (a / n).cast("long")  # a cast drops the fraction on either side of zero


def qrs_energy(samples: DataFrame) -> DataFrame:
    """Append low, high and energy (long) to samples (record, t, value: long): low pass, high
    pass, and the mean size of the slope over the last 80 ms. Before a record all is zero."""
    w = W.partitionBy("record").orderBy("t")
    last = lambda c, n: F.sum(c).over(w.rowsBetween(1 - n, 0))
    before = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0))
    half = LOW // 2
    rows = samples.withColumn("_s", last("value", half)).withColumn("low", quotient(last("_s", half), half * half))
    rows = rows.withColumn("high", before("low", HIGH // 2) - quotient(last("low", HIGH), HIGH))
    rows = rows.withColumn("_d", F.abs(F.col("high") - before("high", SLOPE)))
    return rows.withColumn("energy", F.least(F.lit(MOST), quotient(last("_d", WIDE), WIDE))).drop("_s", "_d")


def noise(samples: DataFrame, beats: DataFrame, after: int, before: int, longest: int) -> DataFrame:
    """(record, t, noise) of each beat (record, t) but a record's first: ten times the range of
    the samples (record, t, value) over their number, from `after` samples past the beat
    before (at most `longest` in all) to `before` samples ahead of it."""
    w = W.partitionBy("record").orderBy("t")
    gaps = beats.withColumn("stop", F.col("t") - before).withColumn("last", F.lag("t").over(w)).where("last is not null")
    gaps = gaps.withColumn("start", F.greatest(F.col("last") + after, F.col("stop") - longest)).where("start < stop")
    cells = F.explode(F.sequence(F.floor(F.col("start") / longest), F.floor((F.col("stop") - 1) / longest)))
    dealt = gaps.select("record", F.col("t").alias("beat"), "start", "stop", cells.alias("cell"))
    placed = samples.withColumn("cell", F.floor(F.col("t") / longest))
    held = dealt.join(placed, ["record", "cell"]).where("t >= start and t < stop")
    size = 10 * (F.max("value") - F.min("value")) / F.count("*")
    return held.groupBy("record", F.col("beat").alias("t")).agg(size.alias("noise"))
