"""Recordings read by byte ranges: a table of ranges is planned from headers and file sizes,
pruned as any table by record, channel and time, and only then read.

A row of the plan is a stretch of a file: SPAN chunks of CHUNK samples of the channels that lie
together in it. Headers alone are read to plan; a file of any size is many rows, so many
tasks. Ranges are read through pyarrow.fs, which must know the scheme of the path (file, hdfs,
s3, gs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.shared import ship

CHUNK = 1 << 14
#: Chunks of a range.
SPAN = 64
SIGNAL = T.StructType(
    [
        T.StructField("record", T.StringType()), T.StructField("channel", T.IntegerType()), T.StructField("chunk", T.LongType()),
        T.StructField("fs", T.DoubleType()), T.StructField("samples", T.ArrayType(T.DoubleType())),
    ]
)
#: What a header tells of channels that lie together: where samples start, samples in all of each
#: channel, and how to take them apart.
LAYOUT = "record string, fs double, path string, channels array<int>, layout string, samples long"


def frames(dtype: str, n: int, signals: list[dict], head: int = 0) -> dict:
    """Samples of n signals in turn. dtype: a numpy type, `u1` for offset bytes or `212` for two
    samples of 12 bits in three bytes; signals: (channel, at, zero, and scale or gain) each."""
    return {"dtype": dtype, "n": n, "per": 1, "signals": signals, "head": head}


def blocks(dtype: str, n: int, per: int, signals: list[dict], head: int) -> dict:
    """Blocks of n samples, of which `per` in a row from `at` on are a signal's."""
    return {"dtype": dtype, "n": n, "per": per, "signals": signals, "head": head}


def width(dtype: str) -> float:
    """Bytes of a sample."""
    return {"212": 1.5, "u1": 1, "i3": 3}.get(dtype) or np.dtype(dtype).itemsize


def samples_in(layout: dict, size: int) -> int:
    """Samples of each channel in a file of `size` bytes."""
    body = size - layout["head"]
    held = body // 3 * 2 if layout["dtype"] == "212" else body // int(width(layout["dtype"]))
    there = max(0, held // layout["n"]) * layout["per"]
    return min(there, layout["limit"]) if layout.get("limit") else there


def numbers(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "212":
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        pair = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] >> 4) << 8], axis=1).ravel()
        return np.where(pair > 2047, pair - 4096, pair)
    if dtype == "u1":
        return np.frombuffer(data, np.uint8).astype(np.int32) - 128
    if dtype == "i3":
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1, 256, 65536], np.int32)
        return np.where(raw >= 1 << 23, raw - (1 << 24), raw)
    return np.frombuffer(data, dtype)


def plan(layouts: DataFrame, span: int = SPAN) -> DataFrame:
    """(record, fs, path, channels, layout, samples, first, count): ranges of `count` chunks from
    the chunk `first` on, for layouts of files."""
    last = F.floor((F.col("samples") - 1) / CHUNK)
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(span).cast("long")))
    found = layouts.where("samples > 0").select("*", firsts.alias("first"))
    return found.withColumn("count", F.least(F.lit(span).cast("long"), F.floor((F.col("samples") - 1) / CHUNK) - F.col("first") + 1))


def pruned(ranges: DataFrame, records: list[str] | None = None, channel: int | None = None, begin: float | None = None, end: float | None = None) -> DataFrame:
    """The ranges that hold some of these records, of a channel, and of the seconds [begin, end)."""
    if records is not None:
        ranges = ranges.where(F.col("record").isin(*records))
    if channel is not None:
        ranges = ranges.where(F.array_contains("channels", channel))
    if begin is not None:
        ranges = ranges.where((F.col("first") + F.col("count")) * CHUNK > begin * F.col("fs"))
    if end is not None:
        ranges = ranges.where(F.col("first") * CHUNK < end * F.col("fs"))
    return ranges


def opened(path: str):
    """An input file of pyarrow for a path as Spark lists it."""
    from pyarrow import fs

    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file("/" + re.sub(r"^(file:)?/*", "", path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def cut(layout: dict, total: int, first: int, count: int, read) -> Iterator[tuple[int, int, np.ndarray]]:
    """(channel, chunk, samples in units) of a range; read(offset, bytes) gives its bytes. What the
    layout has as void is None. Memory: one chunk of all channels that lie together."""
    size, per, n = width(layout["dtype"]), layout["per"], layout["n"]
    for chunk in range(first, first + count):
        start, stop = chunk * CHUNK, min((chunk + 1) * CHUNK, total)
        low, high = start // per, -(-stop // per)  # frames or blocks that hold the chunk
        if layout["dtype"] == "212":
            low, high = low - low % 2, high + high % 2  # two samples share a byte
        raw = numbers(read(layout["head"] + int(low * n * size), int((high - low) * n * size)), layout["dtype"])
        raw = raw[: len(raw) // n * n].reshape(-1, n)
        for s in layout["signals"]:
            own = raw[:, s["at"] : s["at"] + per].reshape(-1)[start - low * per : stop - low * per]
            own = own.astype(np.int64) if own.dtype.kind == "i" else own  # a zero taken off must not wrap
            # Divided by a gain, not multiplied by its inverse, which would be rounded twice.
            units = (own - s["zero"]) / s["gain"] if "gain" in s else (own - s["zero"]) * s["scale"]
            units = units + s.get("base", 0.0)
            if "void" in layout and (none := own == layout["void"]).any():
                units = np.where(none, None, units)  # nulls, not numbers
            yield s["channel"], chunk, units


def read(ranges: DataFrame, channel: int | None = None, begin: float | None = None, end: float | None = None) -> DataFrame:
    """(record, channel, chunk, fs, samples) of the ranges, dealt out over the tasks; of one
    channel, and of chunks that meet the seconds [begin, end), if they are given."""
    ship(ranges.sparkSession)

    def made(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*held), kinds)], names=SIGNAL.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # short chunks go on together
        for batch in batches:
            for row in batch.to_pylist():
                layout = json.loads(row["layout"])
                layout["signals"] = [s for s in layout["signals"] if channel is None or s["channel"] == channel]
                first, last = row["first"], row["first"] + row["count"]
                first = first if begin is None else max(first, int(begin * row["fs"]) // CHUNK)
                last = last if end is None else min(last, -(-int(np.ceil(end * row["fs"])) // CHUNK))
                with opened(row["path"]) as file:
                    for of, chunk, samples in cut(layout, row["samples"], first, last - first, lambda at, n: file.read_at(n, at)):
                        held.append((row["record"], of, chunk, row["fs"], samples if samples.dtype == object else samples.astype(float)))
                        size += len(samples)
                        if size >= CHUNK:
                            yield made(held)
                            held, size = [], 0
        if held:
            yield made(held)

    # A fixed number of tasks: a plan has few bytes, however many its files have, and would be coalesced.
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark takes samples to be as small as the plan they come from, and would broadcast them in a join.
    return pruned(ranges, None, channel, begin, end).repartition(parts, "path", "first").mapInArrow(work, SIGNAL).hint("merge")
