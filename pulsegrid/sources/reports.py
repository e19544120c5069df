"""Delimited text: reports and logs out and in, and pulse logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(report: DataFrame, path: str, append: bool = False, sep: str = "\t") -> None:
    """The rows as delimited text with a header; append adds to what the folder holds."""
    report.write.mode("append" if append else "errorifexists").option("sep", sep).option("header", True).csv(path)


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = "\t") -> DataFrame:
    """Reports or logs with a header; without a schema every column is text. A value that is
    not of its column's type is null."""
    reader = spark.read.option("sep", sep).option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def pulses(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(t: long) of the lines of a tab-separated log whose third field is the label."""
    lines = spark.read.option("sep", "\t").schema("t string, code string, label string").csv(path)
    return lines.where(F.col("label") == label).select(F.col("t").try_cast("long").alias("t"))


#: What stands in a wide log where nothing was tested.
MISSING = "N/A"


def with_average(report: DataFrame, label: str, values: list[str], name: str = "average") -> DataFrame:
    """report (label and values, and maybe more) with a last row that has the means of the values
    under `name`; other columns are null there. Of an empty report the means are null."""
    means = report.agg(*(F.avg(v).alias(v) for v in values)).withColumn(label, F.lit(name))
    return report.withColumn(label, F.col(label).cast("string")).unionByName(means, allowMissingColumns=True)


def wide(log: DataFrame, by: list[str], column: str, value: str, columns: list) -> DataFrame:
    """A log (by, column, value) as text with a column for each of `columns`, MISSING where it has
    no value. The columns are given, so that a wide log of any size is one grouping."""
    table = log.groupBy(*by).pivot(column, columns).agg(F.first(value, ignorenulls=True))
    return table.select(*by, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(str(c)) for c in columns))
