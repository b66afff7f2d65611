"""The registered queries: SQL twins, columns, and results that don't depend on the layout."""

import oracle
import pytest

from textlab.llm import catalog

QUERIES = catalog.queries()
COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2": "doc_id n_shingles component_id",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id size source_size target taken",
    "op6": "doc_id text changed",
    "op7": "doc_id n_words n_removed kept_sha256",
    "op8": "page_id host path rule verdict",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11": "doc_id held_out score predicted",
    "op12": "vec_id code error label_error codebooks_sha256",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, small, name):
    query, sql = QUERIES[name]
    assert oracle.compare(spark, oracle.connect(small), small, query, sql) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_columns_and_rows(spark, small, name):
    result = QUERIES[name][0](spark, small)
    wanted = COLUMNS[name.split("_")[0]].split()
    assert result.columns[: len(wanted)] == wanted
    table = {"op8": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    ids = {r[0] for r in result.select(wanted[0]).collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(wanted[0]).collect()}
