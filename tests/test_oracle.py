"""Every query that has SQL, on the smallest tables, against DuckDB."""

import math
import os

import pytest

from aeroledger.catalog import oracle, queries as catalog

from .conftest import SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")

SQL = oracle.oracle_sql()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        return repr(value) if isinstance(value, float) else str(value)

    return sorted((tuple(text(row[i]) for i in order) for row in rows), key=repr)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SMALL)
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, result.fetchall())
