"""Queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from schemaloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    wanted = connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
