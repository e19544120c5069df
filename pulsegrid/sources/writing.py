"""WFDB recordings written by the tasks: a file a record, streamed from sorted rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.recordings import CODES, VOID, encode_annotations
from pulsegrid.sources.shared import ship

#: Takes the rows of one record in a batch and what the last call left; gives bytes and what to leave.
Encoder = Callable[[pa.RecordBatch, object], tuple[bytes, object]]


def filesystem(folder: str):
    """(file system of pyarrow, path) of a folder."""
    from pyarrow import fs

    if urlsplit(folder).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/*", "", folder)
    return fs.FileSystem.from_uri(folder)


def by_record(df: DataFrame, order: list[str], folder: str, suffix: str, encode: Encoder, head: Callable[[str, int], str] | None = None) -> DataFrame:
    """Write folder/<record><suffix> for every record of df, its rows in order; (record, n rows).

    A task holds one batch at a time. A file gets its name once it is whole, so a task that
    is lost or runs twice leaves no half of one. head(record, rows) is the text of a .hea file beside it."""
    ship(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # files take time, not bytes: not coalesced
    rows = df.where("record is not null").withColumn("record", F.col("record").cast("string")).repartition(parts, "record").sortWithinPartitions("record", *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        name, out, left, n, tag, done = None, None, None, 0, uuid.uuid4().hex, []

        def close() -> None:
            out.close()
            system.move(f"{path}/_{tag}", f"{path}/{name}{suffix}")
            if head:
                with system.open_output_stream(f"{path}/_{tag}") as file:
                    file.write(head(name, n).encode())
                system.move(f"{path}/_{tag}", f"{path}/{name}.hea")
            done.append((name, n))

        for batch in batches:
            names = batch.column("record").to_pylist()
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if names[a] != name:
                    if out is not None:
                        close()
                    name, left, n = names[a], None, 0
                    out = system.open_output_stream(f"{path}/_{tag}")
                data, left = encode(batch.slice(a, b - a), left)
                out.write(data)
                n += b - a
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["record", "n"])

    return rows.mapInArrow(work, "record string, n long")


def write_wfdb(samples: DataFrame, folder: str, fs: float, gains: list[float], bits: int = 16) -> DataFrame:
    """Write samples (record, t, values: a whole number for each channel) as WFDB records of 16 or
    32 bits; (record, n) of what was written. Rows have every t from 0 on. Numbers are cut to 16
    bits; in 32 bits one that does not fit is an error, and a null is the format's mark of no sample."""
    if bits not in (16, 32):
        raise ValueError(f"samples of {bits} bits are not written")

    def encode(batch: pa.RecordBatch, left: object) -> tuple[bytes, object]:
        values = batch.column("values").flatten()
        if bits == 16:
            return np.clip(values.to_numpy(zero_copy_only=False), -32768, 32767).astype("<i2").tobytes(), None
        values = values.cast(pa.int64()).fill_null(VOID).to_numpy()
        if len(values) and (values.min() < VOID or values.max() >= -VOID):
            raise ValueError("a number does not fit 32 bits")
        return values.astype("<i4").tobytes(), None

    def head(name: str, n: int) -> str:
        return f"{name} {len(gains)} {fs:g} {n}\n" + "".join(f"{name}.dat {bits} {g:g}(0)/mV {bits} 0 0 0 0 {k}\n" for k, g in enumerate(gains))

    return by_record(samples.select("record", "t", "values"), ["t"], folder, ".dat", encode, head)


def write_annotations(rows: DataFrame, folder: str, kind: str = "atr") -> DataFrame:
    """Write annotations (record, t, code, sub_type, aux) beside the records; (record, n)."""
    known = rows.where(F.col("code").isin(*CODES.values()))

    def encode(batch: pa.RecordBatch, left: object) -> tuple[bytes, object]:
        last = left or 0  # times are written as steps, so a batch begins where the last one ended
        found = list(zip(*(batch.column(c).to_pylist() for c in ("t", "code", "sub_type", "aux"))))
        data = encode_annotations([(t - last, code, sub or 0, aux or "") for t, code, sub, aux in found])
        return data.removesuffix(b"\0\0") if len(data) > 2 else b"", found[-1][0]

    return by_record(known.select("record", "t", "code", "sub_type", "aux"), ["t", "code", "aux"], folder, f".{kind}", encode)
