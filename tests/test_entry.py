"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, differences

SKIP = {"optimize_mc"}


def test_flagship(spark, small):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert differences(df, con, sql) == ""
