"""Run a stream over what its source holds now, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.sources.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def settled(stream: DataFrame, name: str) -> DataFrame:
    """Everything that the stream appends until its source is read to the end."""
    spark = stream.sparkSession
    out = shared_dir(spark, name)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
