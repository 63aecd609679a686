"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rulespark import catalog

SQL = catalog.oracle_sql()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    kind = type(v).__name__
    if kind.startswith("float"):
        return round(float(v), 6)
    if kind.startswith(("int", "uint")):
        return int(v)
    return bool(v) if kind.startswith("bool") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = rows(catalog.queries()[name](spark, sf).toPandas()), rows(duck.execute(SQL[name]).fetchdf())
    assert got == want
