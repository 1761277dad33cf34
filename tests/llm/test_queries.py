"""Registered queries: contract columns, and every query on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from clausework.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
# The columns of the contracts.
COLUMNS = {
    1: "doc_id size source_size target taken", 2: "doc_id n_assign n_access n_hex base_sha256 spans",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 4: "doc_id held_out score predicted",
    5: "doc_id start n_tokens ids_crc32", 6: "doc_id keep_id group_size kept text_sha256",
    7: "doc_id fingerprint component_id", 8: "query_id rank vec_id score", 9: "doc_id held_out score predicted",
    10: "page_id host path rule verdict", 11: "word form root n n_near form_n",
    12: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", 13: "doc_id n_tokens ids_sha256 decoded_sha256",
}


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert QUERIES.keys() <= entry.queries().keys() and "pipeline" in entry.queries()
    assert ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    mine = df.count()
    if name in ORACLES:
        rows, theirs, same_names, diff = oracle.compare(df, oracle.connect(FOLDER), ORACLES[name])
        assert same_names and diff is None and rows == theirs == mine
    elif name != "op3_packing":
        table = "pages" if "url" in name else "documents"
        assert mine == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
