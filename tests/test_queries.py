"""Every query with an SQL equivalent gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from schemaloom import queries as own

FAST = [q for q in own.oracle_sql() if not q.startswith(("plan_", "phase_", "diff_keys", "diff_foreign", "fk_topology"))]


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", own.oracle_sql())
def test_query_equals_its_sql(spark, sf, database, name):
    found = own.queries()[name](spark, sf)
    wanted = database.execute(own.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["phase", "op", "label", "sql"]
