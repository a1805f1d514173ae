"""Retrieval queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions.hashing import order_key
from kestrel.operators import lexical
from kestrel.operators import norm_search
from kestrel.operators import retrieval as rt
from kestrel.operators import vector_index
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.plans.oracle import sql
from kestrel.session import scratch_folder


@query("c1_bm25_topk", sql(
    "SELECT qid, pid, round(score, 6) AS score, rank FROM fx_run", "fx_run"))
def c1_bm25_topk(spark, d):
    return fx.run(spark, d).select("qid", "pid", r6("score").alias("score"), "rank")


@query("c1b_bm25_index", sql(
    "SELECT qid, pid, round(score, 6) AS score, rank FROM fx_run", "fx_run"))
def c1b(spark, d):
    """The same run from an index that is written, closed and opened again."""
    folder = scratch_folder(spark, "index")
    lexical.build_index(fx.corpus(spark, d), folder, shard_passages=512)
    run, _ = lexical.search(lexical.open_index(spark, folder), fx.queries(spark, d), fx.RUN_DEPTH)
    return run.select("qid", "pid", r6("score").alias("score"), "rank")


@query("c1c_bm25_english", None)
def c1c(spark, d):
    """Stop words dropped, terms stemmed (tests/ has the plain version)."""
    index = lexical.build_index(fx.corpus(spark, d), scratch_folder(spark, "index"), analysis="english")
    run, _ = lexical.search(index, fx.queries(spark, d), fx.RUN_DEPTH)
    return run.select("qid", "pid", r6("score").alias("score"), "rank")


@query("c8_assemble_contexts", sql(
    """SELECT qid, rank, pid AS id, title, text, round(score, 6) AS score FROM fx_ctx""", "fx_ctx"))
def c8_assemble_contexts(spark, d):
    r = fx.retrievals(spark, d)
    ex = r.select("qid", F.posexplode("contexts").alias("rank", "c"))
    return ex.select("qid", F.col("rank").cast("int").alias("rank"), F.col("c.id").alias("id"),
                     F.col("c.title").alias("title"), F.col("c.text").alias("text"),
                     r6("c.score").alias("score"))


# ---------------------------------------------------------------------------
# C2 – C9 on embeddings / corpus
# ---------------------------------------------------------------------------

from kestrel.functions import arrays as ar  # noqa: E402



def vecs(spark, d):
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("qid"),
                                                   "embedding", "label")


_DENSE = sql("""SELECT qid, pid, round(s9, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, pid, s9, row_number() OVER (PARTITION BY qid ORDER BY s9 DESC, pid ASC) - 1 AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS pid,
           round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s9
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank < 10""")


@query("c2b_bounded_topk", _DENSE)
def c2b(spark, d):
    """The same from blocks in order of norm, skipped by their bounds."""
    v = vecs(spark, d)
    r, _ = norm_search.bounded_topk(norm_search.norm_blocks(v), v, 10, exclude_self=True)
    return r.select("qid", "pid", r6("score").alias("score"), "rank")


@query("c2_dense_topk", _DENSE)
def c2(spark, d):
    v = vecs(spark, d)
    r = rt.dense_topk(v, v, k=10, exclude_self=True)
    return r.select("qid", "pid", r6("score").alias("score"), "rank")


@query("c3_l2_normalize", sql("""SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS dim,
  round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) + 0.0 AS value FROM (
  SELECT vec_id, v, unnest(v) AS x, unnest(range(1, 65)) AS i FROM (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""))
def c3(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), ar.l2_normalize("embedding").alias("v"))
    x = e.select("id", F.posexplode("v").alias("dim", "value"))
    return x.select("id", F.col("dim").cast("int").alias("dim"), (r6("value") + F.lit(0.0)).alias("value"))


@query("c4_pool_vectors", sql("""SELECT key, CAST(i - 1 AS INTEGER) AS dim, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT vec_id // 8 AS key, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS i FROM embeddings WHERE label <> 0)
  GROUP BY key, i"""))
def c4(spark, d):
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id") / 8).cast("long").alias("key"), "vec_id", "embedding",
                                                (F.col("label") != 0).cast("int").alias("mask"))
    p = rt.pool_vectors(e, "key", "vec_id", "embedding", mask="mask", mode="mean", dim=64)
    x = p.select("key", F.posexplode("pooled").alias("dim", "value"))
    return x.select("key", F.col("dim").cast("int").alias("dim"), (r6("value") + F.lit(0.0)).alias("value"))


@query("c4b_pool_cls", sql("""SELECT vec_id // 8 AS key, CAST(i - 1 AS INTEGER) AS dim, round(arg_min(x, vec_id), 6) + 0.0 AS value FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL"""))
def c4b(spark, d):
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id") / 8).cast("long").alias("key"), "vec_id", "embedding")
    p = rt.pool_vectors(e, "key", "vec_id", "embedding", mode="cls")
    x = p.select("key", F.posexplode("pooled").alias("dim", "value"))
    return x.select("key", F.col("dim").cast("int").alias("dim"), (r6("value") + F.lit(0.0)).alias("value"))


@query("c5_pq_topk", None)
def c5(spark, d):
    v = vecs(spark, d)
    books = rt.pq_train(v, m=8, nbits=4, seed=1)
    codes = rt.pq_encode(v, books)
    return rt.pq_topk(codes, books, v, k=10).select("qid", "pid", r6("score").alias("score"), "rank")


#: Codebooks that SQL can say too: the sub-vectors of 16 rows.
_BOOKS = "SELECT row_number() OVER (ORDER BY md5('5-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS code, CAST(embedding AS DOUBLE[]) AS b FROM embeddings"


@query("c5b_pq_index", sql(f"""WITH books AS (SELECT code, s, b[s * 8 + 1:s * 8 + 8] AS c FROM ({_BOOKS}), range(8) r(s) WHERE code < 16),
v AS (SELECT vec_id, s, CAST(embedding AS DOUBLE[])[s * 8 + 1:s * 8 + 8] AS x FROM embeddings, range(8) r(s)),
coded AS (SELECT vec_id, s, arg_min(code, round(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12) * 100 + code / 1e12) AS code
  FROM v JOIN books USING (s) GROUP BY vec_id, s),
lut AS (SELECT vec_id AS qid, s, code, list_dot_product(x, c) AS part FROM v JOIN books USING (s) WHERE vec_id % 10 = 0),
scores AS (SELECT qid, vec_id AS pid, round(sum(part), 9) AS s9 FROM lut JOIN coded USING (s, code) GROUP BY qid, vec_id)
SELECT qid, pid, round(s9, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s9 DESC, pid) - 1 AS rank FROM scores) WHERE rank < 10"""))
def c5b(spark, d):
    """A stored index: books first, two additions, opened again."""
    v = vecs(spark, d)
    first = v.orderBy(order_key(5, F.col("pid")), "pid").limit(16).select("embedding").collect()  # the books
    rows = np.array([r["embedding"] for r in first], float)
    books = rows.reshape(16, 8, -1).transpose(1, 0, 2)
    folder = scratch_folder(spark, "vectors")
    index = vector_index.create_vector_index(spark, folder, books)
    index.add(v.where("pid % 3 = 0")).add(v.where("pid % 3 <> 0"))
    index = vector_index.open_vector_index(spark, folder)
    return index.search(v.where("qid % 10 = 0"), 10).select("qid", "pid", r6("score").alias("score"), "rank")


@query("c6_sample_corpus", sql("SELECT doc_id AS pid FROM documents ORDER BY md5('3-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50"))
def c6(spark, d):
    return rt.sample_corpus(fx.corpus(spark, d), 50, seed=3).select("pid")


@query("c7_assign_ids", sql("SELECT doc_id AS pid, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id FROM documents"))
def c7(spark, d):
    return rt.assign_ids(fx.corpus(spark, d).select("pid"), "pid")


@query("c9_distinct_passages", sql("""SELECT md5(text) AS text_md5, arg_max(title, qid * 1000 + rank) AS title, count(*) AS n_refs
  FROM fx_ctx GROUP BY text""", "fx_ctx"))
def c9(spark, d):
    p = rt.distinct_passages(fx.retrievals(spark, d))
    return p.select(F.md5("text").alias("text_md5"), "title", "n_refs")
