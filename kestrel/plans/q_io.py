"""Source/sink (A) queries: round trips through files derived from the
given tables, written under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.plans.oracle import sql
from kestrel.sources import io


@query("a1_read_passages", sql("SELECT doc_id AS pid, source AS title, md5(text) AS text_md5 FROM documents"))
def a1(spark, d):
    path = io.scratch_path(spark, "passages.tsv")
    io.write_passages(fx.corpus(spark, d), path, "tsv")
    p = io.read_passages(spark, path)
    return p.select("pid", "title", F.md5("text").alias("text_md5"))


@query("a1b_read_passages_jsonl", sql("SELECT doc_id AS pid, source AS title, md5(text) AS text_md5 FROM documents"))
def a1b(spark, d):
    path = io.scratch_path(spark, "passages.jsonl")
    io.write_passages(fx.corpus(spark, d), path, "jsonl")
    p = io.read_passages(spark, path)
    return p.select("pid", "title", F.md5("text").alias("text_md5"))


@query("a1d_read_passages_split", sql("SELECT doc_id AS pid, source AS title, md5(text) AS text_md5 FROM documents"))
def a1d(spark, d):
    """Files with quoted newlines, each written where its rows are read, read
    in byte ranges much shorter than a file."""
    path = io.scratch_path(spark, "passages.tsv")
    io.write_passages(fx.corpus(spark, d), path, "tsv")
    p = io.read_passages(spark, path, split=True, range_bytes=1 << 20)
    return p.select("pid", "title", F.md5("text").alias("text_md5"))


QA_SCHEMA = "id long, x string, y string"


def qa_dir(spark, d, **how):
    docs = fx.table(spark, d, "documents")
    lab = fx.table(spark, d, "labels")
    qa = lab.join(docs, "doc_id").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("id"),
        F.col("text").alias("x"), F.col("quality").cast("string").alias("y"))
    path = io.scratch_path(spark, "qa")
    ordered = qa.repartitionByRange("dataset", "id").sortWithinPartitions("dataset", "id")
    io.write_by_dataset(ordered, path, fmt="csv")
    return io.read_qa_dir(spark, path, QA_SCHEMA, dataset_from="partition", **how)


QA_ORACLE = """SELECT lang AS dataset, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS row_id,
  doc_id AS id, CAST(quality AS VARCHAR) AS y, md5(text) AS x_md5 FROM labels JOIN documents USING (doc_id)"""


@query("a2_read_qa_dir", sql(QA_ORACLE))
def a2(spark, d):
    q = qa_dir(spark, d)
    return q.select("dataset", "row_id", "id", "y", F.md5("x").alias("x_md5"))


@query("a2b_read_qa_split", sql(QA_ORACLE))
def a2b(spark, d):
    """The same directory, its files read in byte ranges."""
    q = qa_dir(spark, d, split=True, range_bytes=256 << 10)
    return q.select("dataset", "row_id", "id", "y", F.md5("x").alias("x_md5"))


@query("a3_read_write_retrievals", sql("""SELECT qid, rank, pid AS id, title, md5(text) AS text_md5, round(score, 6) AS score
  FROM fx_ctx""", "fx_ctx"))
def a3(spark, d):
    path = io.scratch_path(spark, "retrievals.json")
    io.write_retrievals(fx.retrievals(spark, d), path)
    r = io.read_retrievals(spark, path)
    ex = r.select("qid", F.posexplode("contexts").alias("rank", "c"))
    return ex.select("qid", F.col("rank").cast("int").alias("rank"), F.col("c.id").alias("id"), F.col("c.title").alias("title"),
                     F.md5("c.text").alias("text_md5"), r6("c.score").alias("score"))


@query("a3b_read_retrieval_array", sql("""SELECT q.q, q.answer AS y, rank, CAST(pid AS VARCHAR) AS id, title, md5(text) AS text_md5,
  round(score, 6) AS score FROM fx_ctx JOIN fx_queries q USING (qid)""", "fx_ctx", "fx_queries"))
def a3b(spark, d):
    """The layout of one array a file with q, y, x and contexts; string ids.
    Half of the questions are read whole files at a time, half by lines."""
    path, by_lines = io.scratch_path(spark, "retrievals-array"), io.scratch_path(spark, "retrievals-lines")
    r = fx.retrievals(spark, d)
    half = r.select("q", F.col("answer").alias("y"), F.col("q").alias("x"), "contexts", (F.col("qid") % 2 == 0).alias("even"))
    io.write_retrieval_array(half.where("even").drop("even"), path)
    io.write_retrieval_array(half.where("not even").drop("even"), by_lines)
    both = io.read_retrieval_array(spark, path).unionByName(io.read_retrieval_array(spark, by_lines, lines=True))
    ex = both.select("q", "y", F.posexplode("contexts").alias("rank", "c"))
    return ex.select("q", "y", "rank", "c.id", "c.title", F.md5("c.text").alias("text_md5"), r6("c.score").alias("score"))


@query("a1c_read_passages_string_ids", sql("SELECT 'doc-' || doc_id AS pid, source AS title, md5(text) AS text_md5 FROM documents"))
def a1c(spark, d):
    """Ids that are no numbers, through both formats."""
    p = fx.corpus(spark, d).withColumn("pid", F.concat(F.lit("doc-"), F.col("pid")))
    path, lines = io.scratch_path(spark, "passages.tsv"), io.scratch_path(spark, "passages.jsonl")
    io.write_passages(p, path, "tsv")
    io.write_passages(io.read_passages(spark, path, id_type="string"), lines, "jsonl")
    return io.read_passages(spark, lines, id_type="string").select("pid", "title", F.md5("text").alias("text_md5"))


@query("a4_pair_datasets", sql(f"""SELECT q.dataset, q.row_id, q.id, r.doc_id AS partner FROM ({QA_ORACLE}) q
  JOIN (SELECT lang AS dataset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1 AS row_id FROM documents) r
  USING (dataset, row_id)"""))
def a4(spark, d):
    from kestrel.operators.ordering import dense_index
    q = qa_dir(spark, d).select("dataset", "row_id", "id")
    docs = fx.table(spark, d, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("partner"))
    other = dense_index(docs, [F.col("partner").desc()], group_cols=["dataset"], out="row_id")
    return io.pair_datasets(q, other).select("dataset", "row_id", "id", "partner")


@query("a5_read_train_examples", sql("""SELECT qid, kind, CAST(i - 1 AS INTEGER) AS pos, md5(c) AS passage_md5 FROM (
  SELECT qid, 'pos' AS kind, unnest(pos) AS c, unnest(range(1, len(pos) + 1)) AS i FROM fx_contrast
  UNION ALL SELECT qid, 'neg', unnest(neg), unnest(range(1, len(neg) + 1)) FROM fx_contrast)""", "fx_contrast"))
def a5(spark, d):
    """Half of the examples as JSON lines, half as a JSON array."""
    from kestrel.plans.q_datasets import contrast_table
    t = contrast_table(spark, d)
    p1, p2 = io.scratch_path(spark, "ex1.jsonl"), io.scratch_path(spark, "ex2.json")
    t.where(F.col("qid") % 2 == 0).write.json(p1)
    io.write_retrieval_array(t.where(F.col("qid") % 2 == 1), p2)
    r = io.read_train_examples(spark, [p1, p2])
    both = [r.select("qid", F.lit(k).alias("kind"), F.posexplode(c).alias("pos", "c"))
            for k, c in (("pos", "positive_ctxs"), ("neg", "negative_ctxs"))]
    return both[0].unionByName(both[1]).select(
        "qid", "kind", "pos", F.md5(tx.compose_passage(F.col("c.title"), F.col("c.text"))).alias("passage_md5"))


@query("a6_write_by_dataset", sql("SELECT dataset, count(*) AS n, CAST(sum(y) AS BIGINT) AS correct FROM fx_preds GROUP BY dataset",
                                  "fx_preds"))
def a6(spark, d):
    path = io.scratch_path(spark, "by_dataset")
    io.write_by_dataset(fx.preds(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("correct"))


@query("a7_skip_if_done", sql("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)"))
def a7(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    done = fx.table(spark, d, "labels").select("doc_id")
    return io.skip_if_done(docs, done, ["doc_id"])


@query("a8_save_load_vectors", sql("""SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings"""))
def a8(spark, d):
    path = io.scratch_path(spark, "vectors")
    io.save_vectors(fx.table(spark, d, "embeddings"), path)
    v = io.load_vectors(spark, path)
    return v.select("vec_id", r6(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0).cast("double"),
                                             lambda a, x: a + x)).alias("total"))
