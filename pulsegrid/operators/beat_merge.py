"""One-to-one merging of two beat streams in time order, for records of any length.

The earliest beat of both streams is paired with the next of the other if that lies within
the window and the beat's own stream has none nearer to it behind; else it stands alone. Cut at any
time, all that the later part must know of the earlier is whether its first beat of either
stream has been taken already: three states. So chunks of time are read from each of the
three, scan.entries() ties them, and each is read once more from the state it is entered in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scan import entries, written
from pulsegrid.sources.shared import ship

#: No beat of the next chunk is taken; its first reference beat; its first test beat.
FREE, REF_TAKEN, TEST_TAKEN = range(3)
#: Windows of a chunk.
CHUNK = 512
MISSING, SHUT_DOWN = "O", "X"


def merged(ref: list[float], test: list[float], end: float, window: float, state: int) -> tuple[list[tuple[int | None, int | None]], int]:
    """(pairs of places, exit state) of a chunk that ends before `end`; the lists also hold the
    beats of two windows behind it."""
    i, j, out = int(state == REF_TAKEN), int(state == TEST_TAKEN), []
    while True:
        a = ref[i] if i < len(ref) else inf
        b = test[j] if j < len(test) else inf
        if a >= end and b >= end:
            break
        if b < a:
            after = test[j + 1] if j + 1 < len(test) else inf
            near = a - b <= window and a - b < abs(a - after)
        else:
            after = ref[i + 1] if i + 1 < len(ref) else inf
            near = b - a <= window and b - a < abs(b - after)
        out.append((i if near or a <= b else None, j if near or b < a else None))
        i, j = i + (near or a <= b), j + (near or b < a)
    return out, REF_TAKEN if i > bisect_left(ref, end) else TEST_TAKEN if j > bisect_left(test, end) else FREE


def merge_beats(ref: DataFrame, test: DataFrame, window: float, chunk: int = CHUNK) -> DataFrame:
    """(record, ref, test, t_ref, t_test) of beats (record, t, code) of two streams: pairs, and
    beats that stand alone with O for the other's code and a null time.

    Of beats of one stream at one time the smaller code comes first. Null records and times are
    left out; empty tables pair nothing. Work is dealt by `chunk` windows of time, never by
    records; what one chunk holds of a record meets in a task.
    """
    if chunk < 2:
        raise ValueError("a chunk has two windows or more")
    ship(ref.sparkSession)
    kind, size = ref.schema["record"].dataType.simpleString(), window * chunk
    sides = [df.where("record is not null and t is not null").select("record", F.lit(k).alias("side"), F.col("t").cast("double").alias("t"), "code") for k, df in enumerate((ref, test))]
    home = F.floor(F.col("t") / size)
    ahead = F.col("t") - home * size < 2 * window
    both = sides[0].unionByName(sides[1]).withColumn("chunk", F.explode(F.when(ahead, F.array(home, home - 1)).otherwise(F.array(home))))
    beat = F.struct("t", "code")
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == k, beat))).alias(f"b{k}") for k in (0, 1)]
    rows = both.groupBy("record", "chunk").agg(*lists, F.min("t").alias("first"))
    rows = rows.withColumn("end", (F.col("chunk") + 1) * size).where(F.col("first") < F.col("end"))
    arrays = [F.col(f"b{k}.{f}").alias(f"{f}{k}") for k in (0, 1) for f in ("t", "code")]
    chunks = written(rows.select("record", "chunk", "end", *arrays), "beat_chunks")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("t0", "t1", "end"))
            exits = [[merged(a, b, end, window, s)[1] for s in (FREE, REF_TAKEN, TEST_TAKEN)] for a, b, end in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("record"), batch.column("chunk"), pa.array(exits, pa.list_(pa.int32()))], names=["record", "chunk", "map"])

    maps = chunks.select("record", "chunk", "end", "t0", "t1").mapInArrow(summed, f"record {kind}, chunk long, map array<int>")
    entered = entries(written(maps, "beat_maps"), FREE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("t0", "code0", "t1", "code1", "end", "entry"))
            of, found = [], [[], [], [], []]
            for k, (a, code_a, b, code_b, end, state) in enumerate(zip(*columns)):
                for i, j in merged(a, b, end, window, state)[0]:
                    of.append(k)
                    row = (MISSING if i is None else code_a[i], MISSING if j is None else code_b[j], None if i is None else a[i], None if j is None else b[j])
                    for values, value in zip(found, row):
                        values.append(value)
            arrays = [pa.array(v, t) for v, t in zip(found, (pa.string(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("record").take(pa.array(of, pa.int64())), *arrays], names=["record", "ref", "test", "t_ref", "t_test"])

    return chunks.join(entered, ["record", "chunk"]).mapInArrow(read, f"record {kind}, ref string, test string, t_ref double, t_test double")


def _inside(rows: DataFrame, t: Column, intervals: DataFrame, size: float, how: str) -> DataFrame:
    """The rows whose t an interval [begin, end] of their record holds (left_semi), or the rest
    (left_anti); cells of `size` make it an equality join."""
    cells = F.sequence(F.floor(F.col("begin") / size), F.floor(F.col("end") / size))
    dealt = intervals.select(F.col("record").alias("_of"), F.explode(cells).alias("_cell"), F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    return rows.join(dealt, (F.col("record") == F.col("_of")) & (F.floor(t / size) == F.col("_cell")) & (t >= F.col("_begin")) & (t <= F.col("_end")), how)


def with_pauses(pairs: DataFrame, size: float, ref_off: DataFrame | None = None, test_off: DataFrame | None = None, flutter: DataFrame | None = None) -> DataFrame:
    """pairs with what is known of pauses (record, begin, end): a beat that stands alone while
    the other stream is shut down gets X in place of O, and an extra test beat during the
    reference's flutter is not counted. `size`: of the cells that pauses are dealt to."""
    pairs = written(pairs, "pairs")
    if flutter is not None:
        pairs = pairs.where("t_ref is not null").unionByName(_inside(pairs.where("t_ref is null"), F.col("t_test"), flutter, size, "left_anti"))
    for label, there, off in (("ref", "t_test", ref_off), ("test", "t_ref", test_off)):
        if off is not None:
            alone = F.col(f"t_{label}").isNull()
            shut = _inside(pairs.where(alone), F.col(there), off, size, "left_semi").withColumn(label, F.lit(SHUT_DOWN))
            pairs = pairs.where(~alone).unionByName(shut).unionByName(_inside(pairs.where(alone), F.col(there), off, size, "left_anti"))
    return pairs
