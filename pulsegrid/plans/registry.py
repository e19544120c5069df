"""Registered queries of the signal engine and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.sources.shared import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("rhythm", "evaluation", "reports", "signal", "kernels", "dims", "stats", "matching", "streams", "models", "beats", "files")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for its rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"pulsegrid.plans.{name}")


def queries() -> dict[str, Query]:
    load()

    def shipped(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        run.__module__, run.__doc__ = function.__module__, function.__doc__
        return run

    return {name: shipped(function) for name, function in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
