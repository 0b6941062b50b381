"""The registered queries against their SQL on the smallest test folder, and the shape of their results."""

import pytest
from oracle import compare, connect

from larder.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# The columns that every result has at least.
COLUMNS = {
    "op1_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_licences": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                     "base_labels": "string", "labels": "string", "score": "double"},
    "op6_near_duplicates": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                          "base_sha256": "string", "spans": "string"},
    "op11_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
                                 "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_token_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                           "sequence_id": "bigint", "offset": "bigint"},
    "op12_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
                    "folded_root": "string", "verified": "boolean"},
    "op10_embedding_duplicates": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert COLUMNS[name].items() <= dict(QUERIES[name](spark, FOLDER).dtypes).items()


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_licences", "op9_personal_data"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
