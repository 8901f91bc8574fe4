"""Operators that SQL can express, against their SQL in DuckDB."""

import os

import duckdb
import pytest

from spanforge.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        path = f"{D}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
