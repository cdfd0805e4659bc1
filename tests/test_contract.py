"""Every check of the contract against DuckDB on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from quarrylint.checks.base import corpus_projects  # noqa: E402
from quarrylint.checks.queries import ORACLE, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in compare.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare.difference(spark, connection, name, SF_DIR).startswith("ok")


def test_projects_are_read_from_the_scan(spark):
    read = corpus_projects(spark, SF_DIR).inputFiles()
    assert not [name for name in read if name.endswith(("part.parquet", "events.parquet"))]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
