"""Retrieval operators against brute force on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import retrieval as rt
from tests.conftest import SF001


def _corpus(spark):
    rows = [(1, "t", "apple banana apple"), (2, "t", "banana cherry"), (3, "", "cherry cherry apple date"),
            (4, "u", "elder"), (5, None, "")]
    return spark.createDataFrame(rows, "pid long, title string, text string")


def _queries(spark):
    return spark.createDataFrame([(10, "apple cherry"), (11, "banana"), (12, "zzz")], "qid long, q string")


def brute_bm25(docs, queries, k1=1.2, b=0.75):
    import re
    tok = lambda s: [t.lower() for t in re.findall(r"\w+|[^\w\s]", s)]
    toks = {pid: tok(((t + " ") if t else "") + x) for pid, t, x in docs}
    n = len(toks)
    avgdl = sum(len(v) for v in toks.values()) / n
    out = {}
    for qid, q in queries:
        for pid, d in toks.items():
            s = 0.0
            for term in set(tok(q)):
                tf = d.count(term)
                if tf:
                    df = sum(term in v for v in toks.values())
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(d) / avgdl))
            if s > 0:
                out[(qid, pid)] = s
    return out


def test_bm25_for_any_block_and_chunk_and_the_join_agree_with_brute_force(spark):
    docs = [(1, "t", "apple banana apple"), (2, "t", "banana cherry"), (3, "", "cherry cherry apple date"),
            (4, "u", "elder"), (5, None, "")]
    ref = brute_bm25(docs, [(10, "apple cherry"), (11, "banana"), (12, "zzz")])
    block = {(r.qid, r.pid): r.score for r in rt.bm25_topk(_corpus(spark), _queries(spark), k=10).collect()}
    small = {(r.qid, r.pid): r.score for r in rt.bm25_topk(_corpus(spark), _queries(spark), k=10, block=1, chunk=1).collect()}
    assert small == block
    scores, postings = rt.bm25_scores(_corpus(spark), _queries(spark))
    joined = {(r.qid, r.pid): r.score for r in rt.rank_run(scores, 10).collect()}
    postings.unpersist()
    assert block.keys() == ref.keys() == joined.keys()
    for key, v in ref.items():
        assert abs(block[key] - v) < 1e-9 and abs(joined[key] - v) < 1e-9


def test_bm25_rank_ties_go_to_smaller_pid(spark):
    c = spark.createDataFrame([(7, "", "x y"), (3, "", "x y"), (5, "", "x y")], "pid long, title string, text string")
    q = spark.createDataFrame([(1, "x")], "qid long, q string")
    got = [(r.rank, r.pid) for r in rt.bm25_topk(c, q, k=2).orderBy("rank").collect()]
    assert got == [(0, 3), (1, 5)]


def test_dense_topk_matches_numpy(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), F.col("vec_id").alias("qid"), "embedding")
    pdf = e.toPandas()
    m = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.pid.to_numpy()
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -np.inf)
    got = rt.dense_topk(e, e, k=5, exclude_self=True).toPandas()
    for qi in [0, 7, 123]:
        order = sorted(range(len(ids)), key=lambda j: (-s[qi, j], ids[j]))[:5]
        exp = [int(ids[j]) for j in order]
        mine = got[got.qid == ids[qi]].sort_values("rank").pid.tolist()
        assert mine == exp


def test_assemble_contexts_orders_by_rank(spark):
    run = rt.bm25_topk(_corpus(spark), _queries(spark), k=3)
    ctx = rt.assemble_contexts(run, _corpus(spark)).where("qid = 10").first()["contexts"]
    scores = [c["score"] for c in ctx]
    assert scores == sorted(scores, reverse=True)


def test_pool_vectors_masked_mean_and_cls(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [100.0, 100.0], 0)],
                               "k long, pos int, v array<double>, m int")
    mean = rt.pool_vectors(df, "k", "pos", "v", mask="m", dim=2).first()["pooled"]
    cls = rt.pool_vectors(df, "k", "pos", "v", mode="cls").first()["pooled"]
    assert mean == [2.0, 3.0] and cls == [1.0, 2.0]


def test_l2_normalize_zero_vector_is_null(spark):
    from kestrel.functions.arrays import l2_normalize
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert got[0] is None and got[1] == [0.6, 0.8]


def test_pq_recall_against_exact(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), F.col("vec_id").alias("qid"), "embedding")
    books = rt.pq_train(e, m=8, nbits=4, seed=1)
    codes = rt.pq_encode(e, books)
    approx = rt.pq_topk(codes, books, e, k=10).toPandas()
    exact = rt.dense_topk(e, e, k=10).toPandas()
    a = set(zip(approx.qid, approx.pid))
    x = set(zip(exact.qid, exact.pid))
    assert len(a & x) / len(x) > 0.3  # recall@10 of an 8×4-bit code on 64-d vectors


def test_query_blocks_equal_single_block(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), F.col("vec_id").alias("qid"), "embedding")
    one = sorted(tuple(r) for r in rt.dense_topk(e, e, k=3).collect())
    many = sorted(tuple(r) for r in rt.dense_topk(e, e, k=3, block=40).collect())
    assert one == many
    books = rt.pq_train(e, m=8, nbits=3, seed=1)
    codes = rt.pq_encode(e, books)
    assert sorted(tuple(r) for r in rt.pq_topk(codes, books, e, k=3).collect()) == sorted(
        tuple(r) for r in rt.pq_topk(codes, books, e, k=3, block=40).collect())


def test_running_topk_equals_a_sort():
    rng = np.random.default_rng(2)
    top = rt._RunningTopK(5, 4)
    top.room = 30
    scores, pids = np.round(rng.random((5, 300)), 1), rng.permutation(300)
    for s in range(0, 300, 17):
        top.add(scores[:, s:s + 17], pids[s:s + 17])
    q, p, s = top.compact()
    for i in range(5):
        want = sorted(zip(-scores[i], pids))[:4]
        assert [(-b, a) for a, b in zip(p[q == i], s[q == i])] == want


def test_bm25_unchanged_by_repartition(spark):
    c = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")
    q = spark.read.parquet(f"{SF001}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    base = sorted((r.qid, r.pid, round(r.score, 9), r.rank) for r in rt.bm25_topk(c, q, k=5).collect())
    for n in (1, 7):
        other = sorted((r.qid, r.pid, round(r.score, 9), r.rank)
                       for r in rt.bm25_topk(c.repartition(n), q.repartition(n), k=5).collect())
        assert other == base


def test_bm25_count_repeats(spark):
    q2 = spark.createDataFrame([(20, "apple apple cherry")], "qid long, q string")
    once = {r.pid: r.score for r in rt.bm25_topk(_corpus(spark), q2, k=10).collect()}
    twice = {r.pid: r.score for r in rt.bm25_topk(_corpus(spark), q2, k=10, count_repeats=True).collect()}
    docs = [(1, "t", "apple banana apple"), (2, "t", "banana cherry"), (3, "", "cherry cherry apple date"),
            (4, "u", "elder"), (5, None, "")]
    apple_only = brute_bm25(docs, [(0, "apple")])
    for pid, s in once.items():
        assert abs(twice[pid] - s - apple_only.get((0, pid), 0.0)) < 1e-9
    scores, _ = rt.bm25_scores(_corpus(spark), q2, count_repeats=True)
    joined = {r.pid: r.score for r in scores.collect()}
    assert all(abs(joined[k] - v) < 1e-9 for k, v in twice.items())


def test_postings_counts_vocab_filter_and_doc_rows(spark):
    import re
    from collections import Counter
    docs = [(1, "t", "apple banana apple"), (2, "t", "banana cherry"), (3, "", "cherry cherry apple date"),
            (4, "u", "elder"), (5, None, "")]
    tok = lambda s: [t.lower() for t in re.findall(r"\w+|[^\w\s]", s)]
    ref = {}
    for pid, t, x in docs:
        toks = tok(((t + " ") if t else "") + x)
        for term, n in Counter(toks).items():
            ref[(pid, term)] = (len(toks), n)
    allp = {(r.pid, r.term): (r.dl, r.tf) for r in rt.bm25_postings(_corpus(spark), None).collect()}
    assert allp == ref
    vocab = spark.createDataFrame([("apple",), ("cherry",)], "term string")
    got = rt.bm25_postings(_corpus(spark), vocab, doc_rows=True).collect()
    terms = {(r.pid, r.term): (r.dl, r.tf) for r in got if r.term is not None}
    assert terms == {k: v for k, v in ref.items() if k[1] in ("apple", "cherry")}
    lens = {r.pid: r.dl for r in got if r.term is None}
    assert lens == {1: 4, 2: 3, 3: 4, 4: 2, 5: 0}


def test_stored_vector_index(spark, tmp_path):
    import numpy as np
    import pytest

    from kestrel.operators import vector_index as vi

    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("qid"), "embedding")
    books = rt.pq_train(e, m=8, nbits=4, seed=1)
    folder = str(tmp_path / "index")
    index = vi.create_vector_index(spark, folder, books)
    assert index.search(e.limit(3), 5).collect() == []
    index = index.add(e.where("pid < 300")).add(e.where("pid >= 300"))
    again = vi.open_vector_index(spark, folder)
    assert np.array_equal(again.books, books)
    assert sorted(map(tuple, again.search(e, 5).collect())) == sorted(map(tuple, rt.pq_topk(rt.pq_encode(e, books), books, e, 5).collect()))
    with pytest.raises(ValueError, match="already"):
        again.add(e.where("pid = 7"))
    assert vi.open_vector_index(spark, folder).codes.count() == 500  # the refused addition does not count
    spark.createDataFrame([("lost", 3)], "addition string, n long").write.mode("append").parquet(f"{folder}/additions")
    spark.createDataFrame([(9000, bytes(8))], "pid long, codes binary").write.parquet(f"{folder}/codes/lost")
    with pytest.raises(ValueError, match="were written"):
        vi.open_vector_index(spark, folder)


def test_bounded_topk_is_exact_and_skips(spark):
    """Norms over four powers of ten, ties, nulls, several slabs."""
    import numpy as np

    from kestrel.operators import norm_search as ns

    rng = np.random.default_rng(6)
    m = rng.normal(size=(1500, 8)) * 10.0 ** rng.uniform(-4, 0, size=(1500, 1))
    m[700:720] = m[3]
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(m)] + [(2000, None, None), (2001, None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "pid long, qid long, embedding array<double>")
    blocks = ns.norm_blocks(df, block_rows=50)
    asked = df.where("qid % 30 = 3")
    run, pairs = ns.bounded_topk(blocks, asked, 5, exclude_self=True, slab=20)
    got = {}
    for r in run.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pid)
    assert len(got) == 50
    for q in got:
        s = np.round(m @ m[q], 9)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(1500), -s))[:5].tolist()
    c = pairs.first()
    assert c.skipped > 0.5 * c.met
    none, _ = ns.bounded_topk(blocks, asked.where("false"), 5)
    assert none.collect() == []


def test_pooling_and_spread_of_wide_vectors(spark):
    import numpy as np

    from kestrel.operators import calibration as cal

    m = np.random.default_rng(2).normal(size=(40, 1024))
    df = spark.createDataFrame([(i % 3, i, [float(x) for x in v]) for i, v in enumerate(m)] + [(9, 99, None)], "k int, i int, v array<double>")
    got = {r.k: r.pooled for r in rt.pool_vectors(df, "k", "i", "v").collect()}
    assert got.keys() == {0, 1, 2} and all(np.allclose(got[k], m[k::3].mean(0)) for k in got)
    spread = {r.k: r.spread for r in cal.embedding_spread(df, "v", ["k"]).collect()}
    assert all(np.isclose(spread[k], m[k::3].std(0, ddof=1).mean()) for k in range(3))
    assert cal.embedding_spread(df.limit(1), "v").first().spread is None


def test_moving_queue_meets_its_window_only(spark):
    import numpy as np

    from kestrel.operators import calibration as cal

    rng = np.random.default_rng(3)
    q, k = rng.normal(size=(2, 90, 4))
    b = np.sort(rng.integers(0, 9, 90))
    df = spark.createDataFrame([(int(b[i]), i, q[i].tolist(), k[i].tolist()) for i in range(90)], "b int, r long, q array<double>, k array<double>")
    for size, block in ((25, 7), (1000, 16), (1, 1024)):
        got = {x.r: x for x in cal.moving_queue_contrast(df.repartition(3), "b", "r", "q", "k", size, 0.5, block=block).collect()}
        assert len(got) == 90
        for i in range(90):
            at = int(np.argmax(b == b[i]))
            s = np.array([q[i] @ k[i], *(k[max(0, at - size):at] @ q[i])]) / 0.5
            assert np.isclose(got[i].loss, np.log(np.exp(s - s.max()).sum()) + s.max() - s[0]) and got[i].hit == float(s[0] >= s.max())
