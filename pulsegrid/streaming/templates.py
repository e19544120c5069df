"""Template matching of beat shapes: which earlier shape a beat has, over a table or a stream.

A record keeps up to eight average shapes. A beat is compared with each at a few shifts, scaled
to its height, by the sum of absolute differences; a near one takes the beat into its average,
else the beat becomes a shape of its own, in place of the rarest if there are eight. Two
shapes that the beat is near to and that are near to each other become one.

Over a stream the shapes are typed keyed state, and so are the beats that still wait: rows are
taken in the order of their time once the watermark has passed them, so batches and order of
arrival change nothing. Rows behind the watermark are left out, and a record that has been
silent for `expire` loses its state. Over a table a task reads its records one after the
other, sorted, with one record's shapes in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pulsegrid.sources.shared import ship

#: Shapes of a record; metrics below which a beat has a shape, a second shape is close as
#: well, and two shapes are one (fixed values).
MOST, MATCH, CLOSE, COMBINE = 8, 1.3, 1.2, 0.8
#: A shape whose last eight metrics stay below this varies little.
RECENT, STEADY = 8, 0.5
#: The metric is stated for so many points.
POINTS = 30
NO_MATCH = 1000.0


@dataclass
class Shape:
    name: int
    points: np.ndarray
    count: int = 1
    since: int = 0
    recent: list[float] = field(default_factory=list)


def _windows(beat: np.ndarray, shift: int) -> np.ndarray:
    """The middle of a beat at every shift, from -shift on."""
    length = len(beat) // 2
    start = (len(beat) - length) // 2
    return np.lib.stride_tricks.sliding_window_view(beat, length)[start - shift : start + shift + 1]


def difference(shape: np.ndarray, beat: np.ndarray, shift: int, scaled: bool = True) -> tuple[float, int]:
    """(metric, shift of the beat) of the best of all shifts, the first of equals."""
    middle, moved = _windows(shape, 0)[0], _windows(beat, shift)
    high, other = np.ptp(middle), np.ptp(moved[shift])
    if high == 0 or other == 0:
        return NO_MATCH, 0
    off = middle - moved * (high / other if scaled else 1.0)
    off -= off.mean(axis=1, keepdims=True)
    totals = np.abs(off).sum(axis=1)
    best = int(totals.argmin())
    return float(totals[best]) / (2 * high if scaled else high + other) * POINTS / len(middle), best - shift


def _moved(beat: np.ndarray, by: int) -> tuple[slice, np.ndarray]:
    """Where the beat meets a shape when moved, and its points there."""
    n = len(beat)
    to = slice(max(0, -by), n - max(0, by))
    return to, beat[to.start + by : to.stop + by]


class Bank:
    """The shapes of one record."""

    def __init__(self, shift: int, shapes: list[Shape] | None = None, named: int = 0):
        self.shift, self.shapes, self.named = shift, shapes or [], named

    def take(self, beat: np.ndarray) -> tuple[int, float, int, bool, int | None]:
        """(shape, metric, shift, whether it is new, shape that was combined with it)."""
        if not self.shapes:
            return self._new(beat, NO_MATCH)
        found = [difference(s.points, beat, self.shift) for s in self.shapes]
        order = np.argsort([m for m, _ in found], kind="stable")
        best, gone = int(order[0]), None
        metric, shift = found[best]
        if len(order) > 1 and found[order[1]][0] < CLOSE:
            other = int(order[1])
            plain = [difference(self.shapes[k].points, beat, self.shift, scaled=False) for k in (best, other)]
            if plain[1][0] < plain[0][0]:
                best, other, plain = other, best, plain[::-1]
                metric, shift = found[best][0], plain[0][1]
            likeness, apart = difference(self.shapes[best].points, self.shapes[other].points, self.shift)
            if likeness < COMBINE and (plain[1][0] < 1.0 or not self._steady(other)):
                best, gone = self._combine(best, other, apart)
        if metric >= MATCH:
            return self._new(beat, metric)
        shape = self.shapes[best]
        variation = difference(shape.points, beat, self.shift, scaled=False)[0]
        for s in self.shapes:
            s.since += 1
        to, points = _moved(beat, shift)
        shape.points[to] += (points - shape.points[to]) / (2 if shape.count == 1 else 8)
        shape.count, shape.since, shape.recent = shape.count + 1, 0, [variation, *shape.recent[: RECENT - 1]]
        return shape.name, metric, shift, False, gone

    def _steady(self, k: int) -> bool:
        return len(self.shapes[k].recent) == RECENT and max(self.shapes[k].recent) < STEADY

    def _combine(self, best: int, other: int, apart: int) -> tuple[int, int]:
        """Put `other` into `best` under the older name; returns the place left and the name gone."""
        a, b = self.shapes[best], self.shapes[other]
        to, points = _moved(b.points, apart)
        a.points[to] = (a.points[to] + points) / 2
        a.count, a.since = a.count + b.count, min(a.since, b.since)
        a.name, gone = min(a.name, b.name), max(a.name, b.name)
        del self.shapes[other]
        return best - (other < best), gone

    def _new(self, beat: np.ndarray, metric: float) -> tuple[int, float, int, bool, None]:
        for s in self.shapes:
            s.since += 1
        shape = Shape(self.named, beat.copy())
        self.named += 1
        if len(self.shapes) < MOST:
            self.shapes.append(shape)
        else:
            rare = min(range(MOST), key=lambda k: (self.shapes[k].count, -self.shapes[k].since))
            self.shapes[rare] = shape
        return shape.name, metric, 0, True, None


FOUND = "t long, shape long, metric double, shift long, is_new boolean, combined long"


def match(beats: DataFrame, key: str = "record", shift: int = 4) -> DataFrame:
    """(key, t, shape, metric, shift, is_new, combined) of a table of beats (key, t, points):
    a shape is named by how many came before it in its record; combined is the name that went
    up in it with this beat. Null keys, times and points are left out; beats of one record are
    as long as each other. Records are read one after the other, sorted, a task for some of them."""
    ship(beats.sparkSession)
    kind = beats.schema[key].dataType.simpleString()
    rows = beats.select(key, "t", "points").dropna().repartition(key).sortWithinPartitions(key, "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, name, names = Bank(shift), None, [key, "t", "shape", "metric", "shift", "is_new", "combined"]
        types = [pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
        for batch in batches:
            found = []
            for of, points in zip(batch.column(key).to_pylist(), batch.column("points").to_pylist()):
                if of != name:
                    bank, name = Bank(shift), of
                found.append(bank.take(np.array(points, float)))
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("t"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return rows.mapInArrow(work, f"{key} {kind}, {FOUND}")


_long, _points = lambda n: StructField(n, LongType()), lambda n: StructField(n, ArrayType(DoubleType()))
SHAPES = StructType([_long("name"), _points("points"), _long("count"), _long("since"), _points("recent")])
WAITING = StructType([_long("at"), _long("t"), _points("points")])
CLOCK = StructType([_long("named"), _long("last")])


class Matcher(StatefulProcessor):
    """The keyed state: shapes, beats that wait for the watermark, names given and the last time."""

    def __init__(self, key: str, shift: int, expire_ms: int):
        self.key, self.shift, self.expire = key, shift, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shapes, self.waiting, self.clock = handle.getListState("shapes", SHAPES), handle.getListState("waiting", WAITING), handle.getValueState("clock", CLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.dropna(subset=["at", "t", "points"])
            if len(part):
                at = part["at"].astype("int64").tolist()
                self.waiting.appendList(list(zip(at, part["t"].astype("int64").tolist(), [[float(x) for x in p] for p in part["points"]])))
                first = min(at + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due, left = sorted((r[0], r[1], list(r[2])) for r in rows if r[0] <= passed), [tuple(r) for r in rows if r[0] > passed]
        named, last = self.clock.get() if self.clock.exists() else (0, None)
        out = []
        if due:
            shapes = [Shape(int(s[0]), np.array(s[1], float), int(s[2]), int(s[3]), list(s[4])) for s in self.shapes.get()]
            bank = Bank(self.shift, shapes, int(named))
            out = [(key[0], t, *bank.take(np.array(points, float))) for _, t, points in due]
            self.shapes.put([(s.name, s.points.tolist(), s.count, s.since, s.recent) for s in bank.shapes])
            last = due[-1][0]
            self.clock.update((bank.named, last))
            self.waiting.put(left) if left else self.waiting.clear()
            self.handle.registerTimer(last + self.expire)
        elif not left and last is not None and last + self.expire <= passed:
            self.shapes.clear()
            self.waiting.clear()
            self.clock.clear()
        if left:
            self.handle.registerTimer(min(r[0] for r in left))
        if out:
            frame = pd.DataFrame(out, columns=[self.key, "t", "shape", "metric", "shift", "is_new", "combined"])
            yield frame.astype({"combined": "Int64"})

    def close(self) -> None:
        pass


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def match_stream(beats: DataFrame, key: str = "record", shift: int = 4, expire_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream of (key, ts, t, points) that has a watermark on ts (timestamp):
    the rows that the watermark has passed, each when it has."""
    spark = beats.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # what keyed lists and timers need
    kind = beats.schema[key].dataType.simpleString()
    rows = beats.selectExpr(key, "ts", "unix_millis(ts) AS at", "t", "points")
    return rows.groupBy(key).transformWithStateInPandas(Matcher(key, shift, expire_ms), f"{key} {kind}, {FOUND}", "Append", "EventTime")
