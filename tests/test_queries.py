"""Each query against its SQL in DuckDB, on the same tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in at) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, D)
    expected = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(expected.columns, expected.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_the_entry_needs_no_session():
    """The driver imports the entry points before it has a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_trace_has_a_finding_of_each_detector(spark):
    n = QUERIES["k33_orchestrate"](spark, D)
    assert {r["count"] for r in n.groupBy("trace_id").count().collect()} == {12}


def test_findings_that_are_read_three_times_are_found_once(spark):
    """The pairs of detectors and the raised confidences read findings that are written, not the windows over spans again."""
    plan = QUERIES["l45_entangled"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "RDD" in plan


def test_spans_are_dealt_by_their_number(spark, monkeypatch):
    """A task of the detectors sorts a bounded number of spans however many there are, and adds them up without a sort."""
    from spanforge.operators import detectors
    from spanforge.sources.adapters import agent_spans

    a = agent_spans(spark, D)
    monkeypatch.setattr(detectors, "ROWS", 500)
    assert detectors.dealt(a).rdd.getNumPartitions() == -(-a.count() // 500)
    assert "SortAggregate" not in detectors.detect_all(a)._jdf.queryExecution().executedPlan().toString()
