"""Each query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quirespark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value) if value is None or isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in found.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
