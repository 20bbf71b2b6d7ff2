"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from marlstone.llm.queries import SQL

SF = "/root/testdata/sf0.001"


def same(rows):
    return sorted(repr([f"{v:.9g}" if isinstance(v, float) else v if v is None else str(v) for v in row]) for row in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got.select(*want.columns).collect()) == same(want.fetchall())
