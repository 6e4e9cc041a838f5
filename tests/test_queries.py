"""Registered queries against DuckDB on the smallest shared tables."""

import os

import duckdb
import pytest
from codestrata import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for file in os.listdir(SF):
        base.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    return base


def plain(frame):
    columns = sorted(frame.columns)
    kept = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    return columns, kept.sort_values(columns).values.tolist()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if name in queries.oracle_sql():
        assert plain(got) == plain(duck.execute(queries.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
