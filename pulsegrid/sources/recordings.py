"""Recordings as tables of chunks: WFDB, EDF, BrainVision and raw binary files.

Spark lists the files and reads the headers; what they say becomes a table of layouts, from
which `ranges` plans byte ranges, prunes them and reads (record, channel, chunk, fs, samples)
rows of CHUNK samples in physical units. Each format has a plan_ function, whose table can be
filtered like any other before ranges.read, and a read_ function for the usual filters.
Annotations come as (record, t, code, sub_type, aux).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources import ranges
from pulsegrid.sources.ranges import CHUNK, LAYOUT, SIGNAL, blocks, frames, samples_in
from pulsegrid.sources.shared import ship

__all__ = ["CHUNK", "SIGNAL"]

ANNOTATION = T.StructType(
    [
        T.StructField("record", T.StringType()), T.StructField("t", T.LongType()), T.StructField("code", T.StringType()),
        T.StructField("sub_type", T.IntegerType()), T.StructField("aux", T.StringType()),
    ]
)
#: Annotation codes by number (fixed values of the format).
CODES = dict(enumerate("N L R a V F J A S E j / Q ~".split(), 1)) | {16: "|", 18: "s", 19: "T"} | dict(enumerate('* D " = p B ^ t + u ? ! [ ] e n @ x f ( ) r'.split(), 20))
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63


def record_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def decoded(df: DataFrame, schema: T.StructType, decode: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that decode() yields for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form, held = to_arrow_schema(schema), []
        for batch in batches:
            for row in batch.to_pylist():
                for found in decode(row):
                    held.append(found)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), form)], schema=form)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), form)], schema=form)

    return df.mapInArrow(run, schema)


def parse_header(text: str) -> tuple[float, list[dict]]:
    """Sampling rate and signals (file, format, gain, zero) of a WFDB header."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    signals = []
    for line in lines[1 : 1 + int(first[1])]:
        p = line.split()
        gain = re.match(r"([0-9.eE+-]+)(?:\((-?\d+)\))?", p[2]) if len(p) > 2 else None
        zero = int(gain[2]) if gain and gain[2] else int(p[4]) if len(p) > 4 else 0
        signals.append({"file": p[0], "format": int(re.match(r"\d+", p[1])[0]), "gain": float(gain[1]) or 200.0 if gain else 200.0, "zero": zero})
    return (float(re.match(r"[0-9.]+", first[2])[0]) if len(first) > 2 else 250.0), signals


def sized(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(dir, file, path, size) of files, which are listed and not read."""
    found = files(spark, folder, pattern).select("path", F.col("length").alias("size"))
    return found.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "size")


def heads(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(dir, head, text) of header files, read whole: they are small."""
    text = F.decode("content", "UTF-8")
    return files(spark, folder, pattern).select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.col("path").alias("head"), text.alias("text"))


def layouts(df: DataFrame, parse: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """(record, fs, path, channels, layout, samples) rows of headers; parse() yields (record, fs,
    layout) for the file of a row, which has path and size."""
    ship(df.sparkSession)

    def rows(row: dict) -> Iterator[tuple]:
        for record, fs, layout in parse(row):
            yield record, fs, row["path"], [s["channel"] for s in layout["signals"]], json.dumps(layout), samples_in(layout, row["size"])

    return decoded(df, T.StructType.fromDDL(LAYOUT), rows)


#: Formats of WFDB signal files that are read, and their samples.
WFDB_TYPES = {16: "<i2", 32: "<i4", 80: "u1", 212: "212"}
#: Stands for no sample in 32 bits.
VOID = -(1 << 31)


def parse_wfdb(row: dict) -> Iterator[tuple]:
    """The layout of a signal file (file) by its header (head, text)."""
    fs, signals = parse_header(row["text"])
    here = [(k, s) for k, s in enumerate(signals) if s["file"] == row["file"]]
    form = here[0][1]["format"]
    if form not in WFDB_TYPES:
        raise ValueError(f"signal format {form} is not read")
    own = [{"channel": k, "at": at, "zero": s["zero"], "gain": s["gain"]} for at, (k, s) in enumerate(here)]
    first = next(x for x in row["text"].splitlines() if x.strip() and not x.startswith("#")).split()
    # Two samples of 12 bits share bytes, so the file alone may seem to hold one more.
    limit = {"limit": int(first[3]) if len(first) > 3 else 0} | ({"void": VOID} if form == 32 else {})
    yield record_name(row["head"]), fs, frames(WFDB_TYPES[form], len(own), own) | limit


def opened_wfdb(folder: str, row: dict) -> Iterator[tuple]:
    """The layouts of a record's signal files, which go into the row one after another."""
    row["head"] = f"{folder}/{row['record']}.hea"
    with ranges.opened(row["head"]) as file:
        row["text"] = file.read().decode()
    for name in dict.fromkeys(re.findall(r"(?m)^(\S+\.dat)\s", row["text"])):
        row |= {"file": name, "path": f"{folder}/{name}"}
        with ranges.opened(row["path"]) as file:
            row["size"] = file.size()
        yield from parse_wfdb(row)


def dealt(named: DataFrame) -> DataFrame:
    """Names of records over a fixed number of tasks: they have few bytes, their files may have many."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.select(F.col("record").cast("string").alias("record")).repartition(parts, "record")


def plan_wfdb(spark: SparkSession, folder: str, named: DataFrame | None = None) -> DataFrame:
    """Ranges of the WFDB records under a folder; signals of one file lie together. Of `named`
    (record), as writing gives it, the tasks open the headers that lie in the folder itself. Without
    it Spark lists the folder, and the driver holds every file of the list."""
    if named is not None:
        return ranges.plan(layouts(dealt(named), lambda row: opened_wfdb(folder, row)))
    listed = heads(spark, folder, "*.hea").withColumn("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^(\S+\.dat)\s"), F.lit(1)))))
    both = sized(spark, folder, "*.dat").join(listed, ["dir", "file"])
    return ranges.plan(layouts(both, parse_wfdb))


def read_wfdb(
    spark: SparkSession, folder: str, channel: int | None = None, records: list[str] | None = None, begin: float | None = None, end: float | None = None,
    named: DataFrame | None = None,
) -> DataFrame:
    """Signals of the WFDB records under a folder, each channel by its own gain and zero; only
    one channel, some records, or chunks that meet the seconds [begin, end). `named` as in plan_wfdb."""
    if named is not None and records is not None:
        named = named.where(F.col("record").isin(*records))
    return ranges.read(ranges.pruned(plan_wfdb(spark, folder, named), records), channel, begin, end)


def parse_annotations(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(t, code, sub_type, aux) of a WFDB annotation file."""
    t, at, held = 0, 0, None
    while at + 2 <= len(data):
        word = int.from_bytes(data[at : at + 2], "little")
        kind, low, at = word >> 10, word & 1023, at + 2
        if word == 0:
            break
        if kind == SKIP:
            high, rest = int.from_bytes(data[at : at + 2], "little", signed=True), int.from_bytes(data[at + 2 : at + 4], "little")
            t, at = t + (high << 16) + rest, at + 4
        elif kind == SUB and held:
            held[2] = low - 1024 if low > 511 else low
        elif kind == AUX:
            if held:
                held[3] = data[at : at + low].decode("latin-1").rstrip("\0")
            at += low + low % 2
        elif kind not in (NUM, CHN):
            if held:
                yield tuple(held)
            t += low
            held = [t, CODES.get(kind, str(kind)), 0, ""]
    if held:
        yield tuple(held)


def read_annotations(spark: SparkSession, folder: str, kind: str = "atr", named: DataFrame | None = None) -> DataFrame:
    """Annotations of the files under a folder, or of the records `named` without listing it. A
    join does not broadcast them: Spark does not know how many a file or name stands for."""
    if named is None:
        return decoded(files(spark, folder, f"*.{kind}"), ANNOTATION, lambda row: ((record_name(row["path"]), *a) for a in parse_annotations(row["content"]))).hint("merge")
    ship(spark)

    def opened(row: dict) -> Iterator[tuple]:
        with ranges.opened(f"{folder}/{row['record']}.{kind}") as file:
            yield from ((row["record"], *a) for a in parse_annotations(file.read()))

    return decoded(dealt(named), ANNOTATION, opened).hint("merge")


def encode_annotations(rows: list[tuple[int, str, int, str]]) -> bytes:
    """The WFDB bytes of (t, code, sub_type, aux) rows in order of t."""
    numbers = {c: n for n, c in CODES.items()}
    out, last = b"", 0
    word = lambda kind, low: (kind << 10 | low & 1023).to_bytes(2, "little")
    for t, code, sub, aux in rows:
        gap = t - last
        if gap > 1023:
            out += word(SKIP, 0) + (gap >> 16).to_bytes(2, "little", signed=True) + (gap & 0xFFFF).to_bytes(2, "little")
            gap = 0
        out += word(numbers[code], gap) + (word(SUB, sub) if sub else b"")
        if aux:
            text = aux.encode("latin-1")
            out += word(AUX, len(text)) + text + b"\0" * (len(text) % 2)
        last = t
    return out + b"\0\0"


def plan_edf(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of EDF (16-bit) and BDF (24-bit) files; signals of one rate lie together. Of a
    file the head is read: 256 bytes, and 256 for each signal."""
    found = sized(spark, folder, "*.[eEbB][dD][fF]")

    def parse(row: dict) -> Iterator[tuple]:
        with ranges.opened(row["path"]) as file:
            data = file.read_at(256, 0)
            data += file.read_at(256 * int(data[252:256]), 256)
        wide = row["path"].lower().endswith("bdf")
        text = lambda a, n: data[a : a + n].decode("latin-1").strip()
        head, records, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
        field = lambda start, size: [text(256 + n * start + k * size, size) for k in range(n)]
        labels, low, high = field(0, 16), list(map(float, field(104, 8))), list(map(float, field(112, 8)))
        dmin, dmax, per = list(map(float, field(120, 8))), list(map(float, field(128, 8))), list(map(int, field(216, 8)))
        starts = [sum(per[:k]) for k in range(n)]
        if records >= 0:  # bytes behind the last data record are none of it
            row["size"] = min(row["size"], head + records * sum(per) * (3 if wide else 2))
        for rate in sorted(set(per)):
            own = [k for k in range(n) if per[k] == rate and "Annotations" not in labels[k]]
            unit = {k: (high[k] - low[k]) / (dmax[k] - dmin[k]) for k in own}
            signals = [{"channel": k, "at": starts[k], "zero": dmin[k], "scale": unit[k], "base": low[k]} for k in own]
            if signals:
                yield record_name(row["path"]), rate / seconds, blocks("i3" if wide else "<i2", sum(per), rate, signals, head)

    return ranges.plan(layouts(found, parse))


def read_edf(spark: SparkSession, folder: str, channel: int | None = None, records: list[str] | None = None, begin: float | None = None, end: float | None = None) -> DataFrame:
    """Signals of EDF and BDF files, pruned as in read_wfdb."""
    return ranges.read(ranges.pruned(plan_edf(spark, folder), records), channel, begin, end)


def plan_brainvision(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of BrainVision data files with headers of the same name. Multiplexed channels lie
    together; vectorised ones one behind the other."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    named = heads(spark, folder, "*.vhdr").select(F.regexp_replace("head", r"\.[^./]*$", "").alias("stem"), "text")
    both = sized(spark, folder, "*.eeg").withColumn("stem", stem).join(named, "stem")

    def parse(row: dict) -> Iterator[tuple]:
        field = lambda name: re.search(rf"(?m)^{name}=(.*)$", row["text"])[1].strip()
        n, fs = int(field("NumberOfChannels")), 1e6 / float(field("SamplingInterval"))
        kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[field("BinaryFormat")]
        scales = [float((field(f"Ch{k + 1}").split(",") + ["", "", "1"])[2] or 1) for k in range(n)]
        record, size = row["stem"].rsplit("/", 1)[-1], row["size"]
        if field("DataOrientation") == "MULTIPLEXED":
            yield record, fs, frames(kind, n, [{"channel": k, "at": k, "zero": 0, "scale": s} for k, s in enumerate(scales)])
        else:
            each = size // int(ranges.width(kind)) // n * int(ranges.width(kind))
            for k, s in enumerate(scales):
                row["size"] = (k + 1) * each
                yield record, fs, frames(kind, 1, [{"channel": k, "at": 0, "zero": 0, "scale": s}], head=k * each)

    return ranges.plan(layouts(both, parse))


def read_brainvision(spark: SparkSession, folder: str, channel: int | None = None, records: list[str] | None = None, begin: float | None = None, end: float | None = None) -> DataFrame:
    """Signals of BrainVision files, pruned as in read_wfdb."""
    return ranges.read(ranges.pruned(plan_brainvision(spark, folder), records), channel, begin, end)


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """(record, t, kind, text, size, channel) of BrainVision marker files: t counts from 0."""
    pattern = r"(?m)^Mk\d+=([^,\r\n]*),([^,\r\n]*),(\d+),(\d+),(\d+)"
    rows = heads(spark, folder, "*.vmrk").select(F.regexp_extract("head", r"([^/]+)\.[^./]*$", 1).alias("record"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("line"))
    part = lambda k: F.regexp_extract("line", pattern, k)
    return rows.select("record", (part(3).cast("long") - 1).alias("t"), part(1).alias("kind"), part(2).alias("text"), part(4).cast("long").alias("size"), part(5).cast("int").alias("channel"))


def plan_raw(spark: SparkSession, folder: str, kind: str = "int16", fs: float = 200.0, gain: float = 1.0) -> DataFrame:
    """Ranges of little-endian files of one channel each, named record.channel."""
    form = {"int16": "<i2", "short": "<i2", "single": "<f4", "double": "<f8"}[kind]

    def parse(row: dict) -> Iterator[tuple]:
        record, channel = row["file"].rsplit(".", 1)
        yield record, fs, frames(form, 1, [{"channel": int(channel), "at": 0, "zero": 0, "scale": gain}])

    return ranges.plan(layouts(sized(spark, folder, "*.[0-9]*"), parse))


def read_raw(
    spark: SparkSession, folder: str, kind: str = "int16", fs: float = 200.0, gain: float = 1.0,
    channel: int | None = None, records: list[str] | None = None, begin: float | None = None, end: float | None = None,
) -> DataFrame:
    """Signals of raw files, pruned as in read_wfdb."""
    return ranges.read(ranges.pruned(plan_raw(spark, folder, kind, fs, gain), records), channel, begin, end)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(record, begin, label) of a text file; lines without three fields are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("record"), parts[1].cast("long").alias("begin"), parts[2].alias("label"))


def write_corrections(corrections: DataFrame, path: str) -> None:
    ordered = corrections.orderBy(F.concat_ws(":", "record", "begin")).select("record", "begin", "label")
    ordered.write.mode("overwrite").csv(path, sep="\t")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Record names of a list file, one a line."""
    name = F.trim("value")
    return spark.read.text(path).select(name.alias("record")).where("record <> ''").orderBy("record")
