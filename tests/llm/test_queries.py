"""Registered queries: against SQL where there is some, else their rows and columns."""

import duckdb
import pytest

from tests.conftest import SF
from tests.oracle_check import compare, connect

from tessera.llm import queries

COLUMNS = {
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_length_buckets": "doc_id n_tokens bucket padded_length batch_id slot",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_language_id": "doc_id held_out lang_pred score rejected",
    "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, name):
    ok, message, rows, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok and rows, message


@pytest.mark.parametrize("name", list(COLUMNS))
def test_one_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[name].split()
    ids = sorted(r[0] for r in found.select("doc_id").collect())
    assert ids == sorted(r[0] for r in duckdb.execute(f"select doc_id from '{SF}/documents.parquet'").fetchall())
