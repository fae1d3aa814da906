"""Every query with an SQL twin gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
