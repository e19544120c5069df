"""Rhythm spans, segments and beats from annotation streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOISE = "(NOISE"
FLUTTER = "(VF"
BOUNDARIES = ("+", "~", "[", "]", "|")


def spans(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """(record, rhythm, begin, end) from annotations (record, t, seq, code, sub_type, aux)
    and lengths (record, n).

    `+` opens a span of its rhythm, `[` one of flutter; `]`, `|` and a `~` with sub_type
    other than 0 close; a `~` with sub_type 0 closes and goes on with the rhythm last set,
    unless that was noise. The last span ends with the record. Empty spans are left out.
    Rows are ordered by (t, seq) within a record.
    """
    w = W.partitionBy("record").orderBy("t", "seq")
    marks = annotations.where(F.col("code").isin(*BOUNDARIES))
    chosen = F.when(F.col("code") == "+", F.col("aux")).when(F.col("code") == "[", F.lit(FLUTTER))
    marks = marks.withColumn("set", chosen).withColumn("latest", F.last("set", ignorenulls=True).over(w))
    resumed = F.when((F.col("code") == "~") & (F.col("sub_type") == 0), F.col("latest"))
    opened = F.nullif(F.coalesce("set", resumed), F.lit(NOISE))
    marks = marks.select("record", opened.alias("rhythm"), F.col("t").alias("begin"), F.lead("t").over(w).alias("next"))
    marks = marks.where("rhythm is not null").join(lengths, "record")
    return marks.select("record", "rhythm", "begin", F.coalesce("next", "n").alias("end")).where("end > begin")


def segments(spans: DataFrame, size: int) -> DataFrame:
    """(record, rhythm, begin, end): whole segments of `size` samples from each span's begin.
    One that would end exactly with its span is not made."""
    starts = F.when(F.col("end") - size > F.col("begin"), F.sequence("begin", F.col("end") - size - 1, F.lit(size).cast("long")))
    made = spans.select("record", "rhythm", F.explode(starts).alias("begin"))
    return made.select("record", "rhythm", "begin", (F.col("begin") + size).alias("end"))


def on_segments(segments: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """Each sample (record, t, ...) beside the segments [begin, end) that hold it: an
    equality join on fixed cells of `size` samples, of which a segment meets two at most."""
    cells = F.array_distinct(F.array(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size)))
    dealt = segments.withColumn("cell", F.explode(cells))
    placed = samples.withColumn("cell", F.floor(F.col("t") / size))
    return dealt.join(placed, ["record", "cell"]).where("t >= begin and t < end").drop("cell")


def heart_rate(n_beats: Column, samples: Column, fs: float) -> Column:
    """Beats a minute; 0 for no duration."""
    seconds = samples / fs
    return F.when(seconds > 0, n_beats / seconds * 60).otherwise(0.0)
