"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.shared import shared_dir, ship

__all__ = ["hinted", "map_texts", "shared_dir", "ship", "slices", "table", "written"]

#: Bytes of text that a Python worker holds as separate strings at one time.
TEXT_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a broadcast side may have, by the lengths of its values.
BROADCAST_BYTES = 64 << 20


def bytes_of(df: DataFrame) -> Column:
    """Bytes of a row: eight for a number, the length of strings, binaries and of the rest as JSON."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size += 8
    return size


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """df (a written table, so that measuring it is cheap) with a broadcast hint if its rows
    and its bytes are counted to be within the bounds, else as it is."""
    rows, size = df.agg(F.count("*"), F.sum(bytes_of(df))).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, text: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    fields: list[tuple[str, pa.DataType, T.DataType]],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts in Arrow batches.

    make() runs once per task and returns a function from a list of texts (null becomes "")
    to one list of values per field. Columns of df that share a name with a field give way
    to it; keep limits the columns carried through.
    """
    ship(df.sparkSession)
    new = {name.lower() for name, _, _ in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    df = df.select(*dict.fromkeys([*carried, text]))
    schema = T.StructType([*(df.schema[c] for c in carried), *(T.StructField(n, t) for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                values = work([x or "" for x in part.column(text).to_pylist()])
                arrays = [part.column(c) for c in carried]
                arrays += [pa.array(v, kind) for v, (_, kind, _) in zip(values, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *(n for n, _, _ in fields)])

    return df.mapInArrow(run, schema)
