"""The registered corpus queries on the smallest driver tables: against SQL, or their columns."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in compare.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_operators_are_registered():
    numbers = {int(name[2 : name.index("_")]) for name in contract.LLM_QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in contract.LLM_QUERIES


@pytest.mark.parametrize("name", list(contract.LLM_ORACLE))
def test_query_equals_sql(spark, connection, name):
    assert compare.difference(spark, connection, name, SF_DIR).startswith("ok")


COLUMNS = {
    "op1_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_toxic_segments": "doc_id held_out score predicted",
    "op8_katz_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op13_vector_tree": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    found = contract.LLM_QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns) and found.count()
