"""Stateful beat detection, the same over a table and over a stream.

Samples of a record come in order; the detector keeps a short history and its thresholds as
its state. The energy of the slope is averaged over a window; its peaks are told apart into
beats and noise by a threshold between the medians of the last eight of either, no beat
follows another within the refractory time, and a peak left out is taken back when no beat
has come for one and a half median intervals.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import fmean, median

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.sources.shared import ship

BEAT = "record long, t long, height double, searched_back boolean"
KEPT = 8


@dataclass(frozen=True)
class Detector:
    """How a detector sums up its last peaks, where between noise and beats its threshold lies, and
    for how long after a beat no other can come (fixed values of the two published variants)."""

    middle: Callable[[list[float]], float] = median
    level: float = 0.475
    quiet: float = 0.2


BY_MEDIAN, BY_MEAN = Detector(), Detector(fmean, 0.3125, 0.195)


def fresh() -> dict:
    return {"last": [], "energy": [], "rise": 0.0, "peak": None, "beats": [], "noise": [], "rr": [], "at": None, "missed": None}


def step(s: dict, t: int, value: float, fs: int, how: Detector = BY_MEDIAN) -> list[tuple[int, float, bool]]:
    """Take one sample; returns the beats that it completes."""
    s["last"] = [*s["last"][-2:], value]
    slope = abs(s["last"][-1] - s["last"][0])
    s["energy"] = [*s["energy"][1 - max(1, fs // 12) :], slope] if fs >= 24 else [slope]
    level = sum(s["energy"]) / len(s["energy"])
    found = []
    if level > s["rise"]:
        s["peak"] = (t, level)
    elif s["peak"] is not None and level < 0.5 * s["peak"][1]:
        at, height = s["peak"]
        s["peak"] = None
        quiet = max(1, round(how.quiet * fs))
        noise = how.middle(s["noise"]) if s["noise"] else 0.0
        beat = how.middle(s["beats"]) if s["beats"] else height
        threshold = noise + how.level * (beat - noise)
        if s["at"] is not None and at - s["at"] < quiet:
            pass  # refractory: part of the last beat
        elif height >= threshold:
            found.append((at, height, False))
        else:
            s["noise"] = [*s["noise"][1 - KEPT :], height]
            if s["missed"] is None or height > s["missed"][1]:
                s["missed"] = (at, height)
    usual = how.middle(s["rr"]) if s["rr"] else None
    if not found and usual and s["at"] is not None and t - s["at"] > 1.5 * usual and s["missed"]:
        if s["missed"][0] - s["at"] >= max(1, round(how.quiet * fs)):
            found.append((*s["missed"], True))
        s["missed"] = None
    for at, height, _ in found:
        if s["at"] is not None:
            s["rr"] = [*s["rr"][1 - KEPT :], at - s["at"]]
        s["beats"], s["at"], s["missed"] = [*s["beats"][1 - KEPT :], height], at, None
    s["rise"] = level
    return found


def advance(state: dict, times: list[int], values: list[float | None], fs: int, how: Detector = BY_MEDIAN) -> list[tuple[int, float, bool]]:
    out = []
    for t, value in zip(times, values):
        if value is not None and value == value:
            out += step(state, t, value, fs, how)
    return out


def frame(record: int, beats: list[tuple[int, float, bool]]) -> pd.DataFrame:
    return pd.DataFrame([(record, *b) for b in beats], columns=["record", "t", "height", "searched_back"])


def detect(samples: DataFrame, fs: int, how: Detector = BY_MEDIAN) -> DataFrame:
    """Beats (record, t, height, searched_back) of a table of samples (record, t, value). A task
    walks its records one after the other, sorted by Spark, with one detector's state and one batch in
    memory; null samples and records are left out."""
    ship(samples.sparkSession)
    kind = samples.schema["record"].dataType.simpleString()
    rows = samples.select("record", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")).dropna().repartition("record").sortWithinPartitions("record", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, fresh()
        for batch in batches:
            names, times, values = (batch.column(c).to_pylist() for c in ("record", "t", "value"))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            of, found = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != name:
                    name, state = names[a], fresh()
                beats = advance(state, times[a:b], values[a:b], fs, how)
                of += [a] * len(beats)
                found += beats
            columns = zip(*found) if found else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("record").take(pa.array(of, pa.int64())), *arrays], names=["record", "t", "height", "searched_back"])

    return rows.mapInArrow(work, BEAT.replace("record long", f"record {kind}", 1))


def detect_stream(samples: DataFrame, fs: int, how: Detector = BY_MEDIAN) -> DataFrame:
    """The same over a stream, whose batches hold each record's samples in order of arrival."""

    def more(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(parts).sort_values("t")
        found = advance(s, rows["t"].tolist(), rows["value"].tolist(), fs, how)
        state.update((json.dumps(s),))
        yield frame(key[0], found)

    return samples.groupBy("record").applyInPandasWithState(more, BEAT, "state string", "append", GroupStateTimeout.NoTimeout)
