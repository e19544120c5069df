"""Every registered signal query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from pulsegrid.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, (int, float, np.number)):
        return round(float(value), 5) + 0.0
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"train_and_score", "univariate_r2"}))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_corpus_folder(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
