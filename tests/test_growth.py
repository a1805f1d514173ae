"""What a worker holds, and how often a step runs, as tables grow."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.operators import datasets as ds
from kestrel.operators import lexical
from kestrel.operators import retrieval as rt
from kestrel.operators import subwords as sw
import kestrel.plans.catalog  # noqa: F401  (registers fixtures in their order)
from kestrel.plans import q_datasets, q_io
from tests.conftest import SF001


def best(scores, pids, k):
    out = []
    for row in np.round(scores, rt.SCORE_DIGITS):
        order = np.lexsort((pids, -row))
        out.append([(int(pids[i]), row[i]) for i in order if row[i] > -np.inf][:k])
    return out


@pytest.mark.parametrize("digits", [6, 1])
def test_running_topk_keeps_few_of_a_first_batch(digits):
    rng = np.random.default_rng(1)
    scores, pids = np.round(rng.normal(size=(300, 2_000)), digits), rng.permutation(2_000)
    scores[3], scores[4, :-1] = -np.inf, -np.inf
    top = rt._RunningTopK(300, 5)
    top.add(scores[:, :1_000], pids[:1_000])
    if digits == 6:
        assert top.n < 300 * 40  # all 300,000 before
    top.add(scores[:, 1_000:], pids[1_000:])
    q, p, s = top.compact()
    assert [[(int(a), b) for a, b in zip(p[q == i], s[q == i])] for i in range(300)] == best(scores, pids, 5)


def test_running_topk_of_some_queries():
    rng = np.random.default_rng(2)
    scores, top = rng.normal(size=(4, 50)), rt._RunningTopK(4, 3)
    top.add(scores[[1, 3]], np.arange(50), np.array([1, 3]))
    q, p, _ = top.compact()
    want = best(scores, np.arange(50), 3)
    assert {i: p[q == i].tolist() for i in range(4)} == {0: [], 1: [x for x, _ in want[1]], 2: [], 3: [x for x, _ in want[3]]}


def test_pairs_of_equal_ids():
    qids, pids = np.array([5, 2, 5, 9]), np.array([2, 5, 7, 5])
    assert set(zip(*(x.tolist() for x in rt._pairs_of_equals(qids, pids)))) == {
        (i, j) for i, a in enumerate(qids) for j, b in enumerate(pids) if a == b}


def test_codes_are_made_once_for_all_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    books, codes, qs = rng.normal(size=(4, 8, 2)), rng.integers(0, 8, (60, 4)), rng.normal(size=(30, 8))
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            met.add(len(pdf))
            yield pdf

    coded = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(codes)], "pid long, codes array<int>").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "qid long, embedding array<double>")
    got = rt.pq_topk(coded.mapInPandas(counted, coded.schema), books, asked, 5, block=10).collect()
    assert met.value == 60
    tables = np.stack([qs[:, 2 * s:2 * s + 2] @ books[s].T for s in range(4)], axis=1)  # the sum of a code's entries in the query's tables
    want = best(sum(tables[:, s, :][:, codes[:, s]] for s in range(4)), np.arange(60), 5)
    assert {(r.qid, r.rank): (r.pid, round(r.score, 6)) for r in got} == {
        (i, n): (p, round(s, 6)) for i, row in enumerate(want) for n, (p, s) in enumerate(row)}


def test_only_words_of_the_vocabulary_reach_python(spark):
    corpus = spark.createDataFrame([(1, "t", "one two two three"), (2, None, None), (3, "", "four")], "pid long, title string, text string")
    index = rt.bm25_doc_index(corpus, np.array(["three", "two"], dtype=object))
    child = index._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "filter(" in child and "IN (three,two)" in child.replace("INSET three, two", "IN (three,two)")
    assert {r.pid: (r.dl, list(r.idx or [])) for r in index.collect()} == {1: (5, [1, 1, 0]), 2: (0, []), 3: (1, [])}


def test_subwords_handle_a_batch_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, ""] * 200)], ["text"])
    parts = list(sw._with_column(batch, 0, "n", len, pa.int32()))
    assert max(p.num_rows for p in parts) <= sw.HANDLED
    assert [x for p in parts for x in p.column(1).to_pylist()] == [1, None, 0] * 200


def test_canonical_unicode_handles_a_batch_in_parts(spark):
    rows = ["é", None, "", "plain", "é"] * 200
    assert tx._normalized(pa.array(rows), "NFC").to_pylist() == ["é", None, "", "plain", "é"] * 200
    assert tx._normalized(pa.array([], pa.string()), "NFD").to_pylist() == []
    df = spark.createDataFrame([(x,) for x in rows[:5]], "v string")
    plan = df.select(tx.canonical_unicode("v").alias("c"))
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.c for r in plan.collect()] == ["é", None, "", "plain", "é"]
    assert [r.c for r in df.select(tx.canonical_unicode("v", "NFD").alias("c")).collect()] == ["é", None, "", "plain", "é"]


def test_split_passages_are_written_where_they_are_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "s", f'a\n"{i}"\n') for i in range(40)], "doc_id long, source string, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen, write = [], q_io.io.write_passages
    monkeypatch.setattr(q_io.io, "write_passages", lambda df, *a: (seen.append(df.rdd.getNumPartitions()), write(df, *a)))
    assert q_io.a1d(spark, str(tmp_path)).count() == 40
    assert seen[0] > 1


def test_augmenting_reads_the_chunks_once(spark):
    plan = q_datasets.h10(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1
    t = spark.createDataFrame([(1, list(range(50))), (2, []), (None, [7])], "k long, tokens array<int>")
    for mode in ("delete", "mask", "replace", "shuffle"):
        a = ds.augment_tokens("tokens", mode, 0.3, 9, F.col("k"))
        b = ds.augment_tokens("tokens", mode, 0.3, 9, F.col("k"), draws="draws")
        got = t.withColumn("draws", ds.augment_draws("tokens", 9, F.col("k"))).select(a.alias("a"), b.alias("b")).collect()
        assert all(r.a == r.b for r in got)


def test_postings_are_finished_a_batch_at_a_time():
    rng = np.random.default_rng(4)
    rows = [{"term": f"t{i:02}", "shard": 0, "slots": (s := np.unique(rng.integers(0, 400, i))).tolist(),
             "tfs": rng.integers(1, 9, len(s)).tolist(), "dls": rng.integers(1, 99, len(s)).tolist()} for i in range(1, 40)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("term", pa.string()), ("shard", pa.int64()), *[
        (c, pa.list_(pa.int32())) for c in ("slots", "tfs", "dls")]]))
    plain, whole = ([r for b in f(1.2, 0.75, 20.0)(iter([batch])) for r in b.to_pylist()] for f in (lexical._finish, lexical._finish_apart))
    assert plain == whole
