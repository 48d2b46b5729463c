"""The SQL of this subpackage's queries gives their rows."""

import duckdb
import pytest

from quirespark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in "documents embeddings pages benchmark conversations".split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted((tuple(row[names.index(c)] for c in sorted(names)) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in found.collect()), key=repr) == want
