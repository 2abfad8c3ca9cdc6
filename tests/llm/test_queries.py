import pytest

from tests.oracle import DATA, compare
from weftgraph.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_urlfilter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_quotes": "conv_id bigint, turn bigint, role string, reply_to bigint, thread bigint, text string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns(spark, name):
    got = dict(QUERIES[name](spark, DATA).dtypes)
    for column in COLUMNS[name].split(", "):
        field, kind = column.split(" ")
        assert got[field] == kind


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0
