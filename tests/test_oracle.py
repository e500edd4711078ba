"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from wordmill.plans import oracle, queries

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(oracle.SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert set(oracle.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(oracle.SQL) == {"t13_viterbi"}
    assert set(queries.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
