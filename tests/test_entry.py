"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_entry(spark):
    rows = {r.severity: r.n for r in entry.entry(spark).collect()}
    assert rows == {"severe": 12, "moderate": 365, "minor": 310, "info": 445, "unknown": 697}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# The whole job is covered by test_explain; it would take most of the time here.
SLOW = {"explanations_csv"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, sf_dir, name):
    query = entry.queries()[name](spark, sf_dir)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = query.toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_workers_need_no_installed_package(tmp_path, sf_dir):
    """From another folder, with nothing on the workers' path."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        f"print('rows', e.queries()['knn_exact'](s, {sf_dir!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5000" in done.stdout, done.stderr[-2000:]
