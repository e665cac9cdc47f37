"""Registered queries against their SQL on a small scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


def names():
    from pitstats.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_equals_sql(spark, con, name):
    from pitstats.plans import registry

    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    from pitstats.plans import registry

    assert registry.entry(spark, SF).count() > 0
