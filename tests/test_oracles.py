"""Every query with SQL, side by side with DuckDB on the smallest tables; the others run."""

import datetime
import decimal

import duckdb
import pandas as pd
import pytest

from faultline.plans import catalog
from faultline.plans.fixtures import TABLES

SQL = catalog.oracles()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 8)).removesuffix(".0")  # pandas shows a column of whole numbers with nulls as floats
    if isinstance(x, (datetime.datetime, pd.Timestamp)):
        return x.isoformat()
    return str(bool(x)) if type(x).__name__ in ("bool", "bool_") else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(found) > 0
