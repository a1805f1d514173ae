"""Registered queries: contract columns and types, and the DuckDB oracles."""

import pytest

from kestrel.llm.catalog import ORACLES, QUERIES
from kestrel.plans.check import compare, duck
from tests.conftest import SF001

CONTRACT = {
    "op1_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op2_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_nn_descent": "query_id:bigint rank:int vec_id:bigint score:double",
    "op4_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op5_chat_formatting": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op6_source_mixing": "doc_id:bigint domain:string lang:string source:string n_tokens:bigint copies:int",
    "op7_sentencepiece": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op8_near_dups": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op9_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op10_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint "
                          "base_failed:boolean kept:boolean",
    "op11_turn_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string "
                        "repaired_sha256:string",
    "op12_filter_audit": "part:string filter_order:string step:int kept:bigint removed:bigint redundant:bigint unique_fails:bigint "
                         "good_lost:bigint toxic_lost:bigint shapley:bigint",
    "op13_bit_sliced_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
}


def test_all_are_registered():
    assert set(QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = QUERIES[name](spark, SF001)
    assert dict(df.dtypes) == dict(c.split(":") for c in CONTRACT[name].split())
    if name in ORACLES:
        got = compare(df, duck(SF001), ORACLES[name])
        assert got["values_match"], got
    else:
        table = {"op1": "pages", "op2": "documents", "op7": "documents", "op9": "documents"}.get(name.split("_")[0])
        n = spark.read.parquet(f"{SF001}/{table}.parquet").count() if table else df.select("query_id").distinct().count() * 10
        assert df.count() == n
