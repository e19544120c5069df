"""Labelled arrays in long form: a row per value, a column per dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.operators.scan import written


def reduce(df: DataFrame, keep: list[str], value: str, along: str, ddof: int = 0) -> DataFrame:
    """The reductions of value along one dimension; NaN and null are left out."""
    v = F.when(~F.isnan(value), F.col(value))
    var = F.var_pop(v) if ddof == 0 else F.var_samp(v)
    return df.groupBy(*keep).agg(
        F.bool_and(v != 0).alias("all"), F.bool_or(v != 0).alias("any"), F.min_by(along, F.when(v.isNotNull(), F.struct(-v, F.col(along)))).alias("argmax"),
        F.min_by(along, F.when(v.isNotNull(), F.struct(v, F.col(along)))).alias("argmin"), F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"),
        F.sum(v).alias("sum"), F.product(v).alias("prod"), (F.max(v) - F.min(v)).alias("ptp"), F.sqrt(var).alias("std"), var.alias("var"), F.count(v).alias("n"),
    )


def binned(dim: Column, edges: list[tuple[float, float, str]]) -> Column:
    """Label of the half-open interval that holds the coordinate, else null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(edges):
        out = F.when((dim >= low) & (dim < high), label).otherwise(out)
    return out


def numbered(df: DataFrame, dim: str, name: str = "place") -> DataFrame:
    """(dim, place, total): the distinct coordinates of a dimension in order, numbered from 0.

    Coordinates are dealt out by range, numbered within each part and written, so that all that
    follows is of one numbering; the parts' sizes, of which there are as many as partitions,
    give where each part starts."""
    names = df.select(dim).distinct().repartitionByRange(dim).sortWithinPartitions(dim)
    local = written(names.select(dim, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(W.partitionBy()).alias("total"))
    placed = local.join(F.broadcast(starts), "_part")  # one row per partition
    return placed.select(dim, (F.col("_start") + F.col("_id") - F.col("_low")).alias(name), "total")


def equal_bins(df: DataFrame, dim: str, bins: int) -> DataFrame:
    """Append bin: the dimension's distinct coordinates in order, cut into equal counts."""
    placed = numbered(df, dim).select(dim, F.floor(F.col("place") * bins / F.col("total")).alias("bin"))
    return df.join(placed, dim)


def split_bins(df: DataFrame, dim: str, at: list[int]) -> DataFrame:
    """Append bin: the coordinates in order, cut before each of these places."""
    bin_of = sum(((F.col("place") >= k).cast("int") for k in at), F.lit(0))
    return df.join(numbered(df, dim).select(dim, bin_of.alias("bin")), dim)


def extend(one: DataFrame, other: DataFrame) -> DataFrame:
    """One after the other along a dimension; ValueError unless they have the same columns."""
    if sorted(one.columns) != sorted(other.columns):
        raise ValueError(f"dimensions differ: {one.columns} and {other.columns}")
    return one.unionByName(other)


def add_dim(df: DataFrame, name: str, values: list) -> DataFrame:
    """Repeat every row for each value of a new dimension."""
    if name in df.columns:
        raise ValueError(f"dimension {name} exists")
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def select(df: DataFrame, condition: str, dims: list[str]) -> DataFrame:
    """Rows that a condition on dimensions holds for; an AnalysisException on other columns."""
    # An empty table of the dimensions alone: the condition has to make sense there.
    df.sparkSession.createDataFrame([], df.select(*dims).schema).where(condition).columns  # noqa: B018
    return df.where(condition)


def index(df: DataFrame, **chosen: int | slice | list[int]) -> DataFrame:
    """Rows by places along dimensions, as an array is indexed: a number picks one coordinate
    and drops the dimension, a slice or a list keeps it. Negative places count from the end.
    A number or an entry of a list that no coordinate has is an IndexError."""
    for dim, want in chosen.items():
        places = numbered(df, dim)
        total = places.count()
        if isinstance(want, slice):
            first, stop, step = want.indices(total)
            kept = list(range(first, stop, step)) if step < 0 else None
            inside = F.col("place").isin(kept) if kept is not None else (F.col("place") >= first) & (F.col("place") < stop) & ((F.col("place") - first) % step == 0)
        else:
            wanted = [want] if isinstance(want, int) else want
            if any(not -total <= k < total for k in wanted):
                raise IndexError(f"{dim} has {total} coordinates: {wanted}")
            inside = F.col("place").isin([k % total for k in wanted])
        df = df.join(places.where(inside).select(dim), dim, "left_semi").select(*df.columns)
        df = df.drop(dim) if isinstance(want, int) else df
    return df


def new_axis(df: DataFrame) -> DataFrame:
    """A dimension of one coordinate, named newaxis_0, or the first number that is free."""
    k = next(k for k in range(len(df.columns) + 1) if f"newaxis_{k}" not in df.columns)
    return df.withColumn(f"newaxis_{k}", F.lit(0))


def assign(df: DataFrame, condition: Column, value: str, to: Column) -> DataFrame:
    """The values where a condition on the coordinates holds, replaced."""
    return df.withColumn(value, F.when(condition, to).otherwise(F.col(value)))


def add_fields(df: DataFrame, **fields: Column | str) -> DataFrame:
    """New columns: of given values, or empty ones of a type's name. ValueError for a name that
    is there already."""
    if taken := sorted(set(fields) & set(df.columns)):
        raise ValueError(f"fields exist: {taken}")
    return df.withColumns({k: F.lit(None).cast(v) if isinstance(v, str) else v for k, v in fields.items()})


def remove_fields(df: DataFrame, *names: str) -> DataFrame:
    if absent := sorted(set(names) - set(df.columns)):
        raise ValueError(f"no such fields: {absent}")
    return df.drop(*names)


def repeat(df: DataFrame, dim: str, times: int) -> DataFrame:
    """Every coordinate `times` times; again tells the copies apart."""
    return df.withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def diagonal(df: DataFrame, one: str, other: str) -> DataFrame:
    """Values at equal places along two dimensions, which become one: diagonal."""
    a, b = (numbered(df, d, "diagonal").select(d, "diagonal") for d in (one, other))
    return df.join(a, one).join(b, [other, "diagonal"]).drop(one, other)


def squeeze(df: DataFrame) -> DataFrame:
    """Without the columns that have one value only, but the last (the array's values)."""
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in df.columns[:-1])).first().asDict()
    return df.drop(*(c for c, n in counts.items() if n <= 1))


def by_bin(df: DataFrame, keep: list[str], value: str, function: Callable[[list, list], float], kind: str = "double") -> DataFrame:
    """(keep, value): function(values, counts) of each group, where no built-in aggregate says it:
    the distinct values in order, and how often each occurs. Rows are counted before they are
    shuffled, so what a task holds of a group grows with its distinct values alone; round values
    that hardly repeat. Null values are left out; a group of none gives null."""
    counts = df.groupBy(*keep, value).agg(F.count("*").alias("_n")).where(F.col(value).isNotNull())
    lists = counts.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")))).alias("_all"))
    held = lists.select(*keep, F.col("_all.v").alias("_v"), F.col("_all.n").alias("_c"))
    schema = T.StructType([*(held.schema[c] for c in keep), T.StructField(value, T.StructType.fromDDL(f"v {kind}")[0].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(v, n) for v, n in zip(batch.column("_v").to_pylist(), batch.column("_c").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, to_arrow_type(schema[value].dataType))], names=schema.names)

    groups = df.select(*keep).distinct()
    same = [groups[c].eqNullSafe(F.col(f"_r.{c}")) for c in keep]
    both = groups.join(held.mapInArrow(work, schema).alias("_r"), same, "left")
    return both.select(*(groups[c] for c in keep), F.col(f"_r.{value}").alias(value))


def flattened(df: DataFrame, dims: list[str], name: str = "place") -> DataFrame:
    """df with the place of each value when the dimensions, the last running fastest, are put one
    behind the other. Places of a dimension are those of its coordinates in order."""
    out, radix = df, F.lit(1).cast("long")
    place = F.lit(0).cast("long")
    for k, dim in reversed(list(enumerate(dims))):
        out = out.join(numbered(df, dim, f"_p{k}").withColumnRenamed("total", f"_n{k}"), dim)
        place, radix = place + F.col(f"_p{k}") * radix, radix * F.col(f"_n{k}")
    return out.withColumn(name, place).drop(*(f"_{c}{k}" for k in range(len(dims)) for c in "pn"))


def reshaped(df: DataFrame, dims: list[str], shape: dict[str, int]) -> DataFrame:
    """df with new dimensions (name: size, numbered from 0) in place of `dims`, values in their
    order. One size may be -1 and follows from the rest; ValueError unless the sizes fit."""
    sizes, whole = dict(shape), 1
    for dim in dims:
        whole *= df.select(dim).distinct().count()
    known = 1
    for size in sizes.values():
        known *= size if size != -1 else 1
    free = [k for k, v in sizes.items() if v == -1]
    if len(free) > 1 or (free and (known == 0 or whole % known)) or (not free and known != whole):
        raise ValueError(f"{whole} places do not make {shape}")
    for k in free:
        sizes[k] = whole // known
    out, radix = flattened(df, dims, "_flat").drop(*dims), 1
    for k, size in reversed(sizes.items()):
        out, radix = out.withColumn(k, F.floor(F.col("_flat") / radix) % size), radix * size
    return out.drop("_flat")


def swapped(df: DataFrame, one: str, other: str) -> DataFrame:
    """df with two dimensions changed about: what was said of one is said of the other."""
    return df.select(*(F.col(other if c == one else one if c == other else c).alias(c) for c in df.columns))


def compressed(df: DataFrame, dim: str, keep: list[bool]) -> DataFrame:
    """The values whose coordinate, by its place, is marked; those behind the marks are left out."""
    places = [k for k, on in enumerate(keep) if on]
    return df.join(numbered(df, dim).where(F.col("place").isin(*places)).select(dim), dim, "left_semi")
