"""Registered queries against their DuckDB oracles at sf0.01.

The full catalogue runs with ``KESTREL_ALL_ORACLES=1`` (or
``python -m kestrel.plans.check``); by default one query per operator group.
"""

import os

import pytest

from kestrel.plans.catalog import ORACLES, QUERIES
from kestrel.plans.check import compare, duck
from tests.conftest import SF001, SF01

DEFAULT = ["c1_bm25_topk", "c2_dense_topk", "b1_normalize_text", "b4_normalize_answer", "d1_has_answer",
           "d3_ir_metrics", "e4_threshold_stop", "e6_merge_best_k", "f6_distribution_divergence",
           "g4_auroc", "g7_evaluate_predictions", "h8_pack_chunks", "h15_pick_contrast", "h17c_subword_round_trip", "j1_score_stage",
           "a1d_read_passages_split", "a2_read_qa_dir", "a2b_read_qa_split", "a3b_read_retrieval_array", "a5_read_train_examples", "b15_parse_list", "g15_inbatch_accuracy",
           "g16_queue_contrast", "i2_fit_temperature"]
NAMES = sorted(ORACLES) if os.environ.get("KESTREL_ALL_ORACLES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF01), con, ORACLES[name])
    assert res["values_match"], res


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"c1c_bm25_english", "c5_pq_topk", "h12b_subword_batch", "h17b_subword_truncate", "i1_fit_probe",
                         "i1b_weighted_probe"}


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["dataset", "n", "acc", "ece", "brier", "nll", "auroc"]
    assert df.count() >= 0


def test_queries_run_on_smallest_scale(spark):
    for name in ["b9_render_chat", "h14b_mixture_sample", "c9_distinct_passages"]:
        assert QUERIES[name](spark, SF001).count() >= 0
