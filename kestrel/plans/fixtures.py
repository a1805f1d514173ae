"""Derived fixtures over the given test tables (Spark side).

Each fixture is a deterministic function of the parquet tables, so every
registered query's work grows with the input. The DuckDB oracle rebuilds
the same fixtures from the same tables in ``kestrel.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.functions.hashing import uniform
from kestrel.operators import retrieval as rt

RUN_DEPTH = 40
N_TEMPS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    """pid, title (= source), text."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")


def queries(spark, d) -> DataFrame:
    """qid, q, answer = first 4 lower-cased tokens of the item text."""
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("q"),
                    F.array_join(F.slice(tx.word_tokens("text"), 1, 4), " ").alias("answer"))


def run(spark, d, k: int = RUN_DEPTH) -> DataFrame:
    """BM25 top-k run (qid, pid, score, rank), a table in the checkpoint
    folder."""
    return rt.bm25_topk(corpus(spark, d), queries(spark, d), k=k)


def retrievals(spark, d, k: int = RUN_DEPTH) -> DataFrame:
    """qid, q, answer, contexts (array<struct<id,title,text,score>>)."""
    ctx = rt.assemble_contexts(run(spark, d, k), corpus(spark, d))
    return queries(spark, d).join(ctx, "qid")


def attempts(spark, d) -> DataFrame:
    """One row per (qid, rank, temperature) of the run with hashed
    confidence c and stop probability prob, both rounded to 2 so ties occur."""
    x = run(spark, d).select("qid", "rank", "pid",
                             F.explode(F.sequence(F.lit(0), F.lit(N_TEMPS - 1))).alias("t"))
    return x.select(
        "qid", "rank", "pid", "t",
        ((F.col("t") + 10) / 10.0).alias("temperature"),
        F.round(uniform("c", F.col("qid"), F.col("pid"), F.col("t")), 2).alias("c"),
        F.round(uniform("prob", F.col("qid"), F.col("pid"), F.col("t")), 2).alias("prob"))


def preds(spark, d) -> DataFrame:
    """dataset, id, y, p, y_pred, c_type, c_raw (labels ⋈ documents)."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    j = lab.join(docs, "doc_id")
    u_type = uniform("ctype", F.col("doc_id"))
    c_type = F.when(u_type < 0.34, "ling").when(u_type < 0.67, "number").otherwise("ct")
    u_c = uniform("craw", F.col("doc_id"))
    c_raw = (F.when(c_type == "ling", tx.verbal_label(F.floor(u_c * 11)))
             .when(c_type == "number",
                   F.when(u_c < 0.5, F.floor(u_c * 22).cast("string"))
                   .otherwise(F.concat(F.floor(u_c * 20 - 10).cast("string"), F.lit(".5"))))
             .otherwise(F.concat(F.round(u_c * 100, 1).cast("string"), F.lit(" (0-100)"))))
    first_word = F.regexp_extract("text", tx.TOKEN_PATTERN, 1)  # first token only
    return j.select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("id"),
        F.col("quality").alias("y"),
        F.round(uniform("p", F.col("doc_id")), 2).alias("p"),
        F.when(uniform("na", F.col("doc_id")) < 0.1, F.lit("No answer"))
         .otherwise(F.concat(F.lit("The answer is "), first_word)).alias("y_pred"),
        c_type.alias("c_type"), c_raw.alias("c_raw"))


def logits(spark, d) -> DataFrame:
    """id, logits (first 11 embedding entries, double), y = label."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.slice("embedding", 1, 11).cast("array<double>").alias("logits"),
                    F.col("label").alias("y"))


def tokens(spark, d) -> DataFrame:
    """doc_id, tokens: word tokens mapped to int(md5 prefix) % 30000."""
    docs = table(spark, d, "documents")
    ids = F.transform(tx.word_tokens("text", lower=False),
                      lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % 30000).cast("int"))
    return docs.select("doc_id", ids.alias("tokens"))


def uniform_of(prompt: str):
    """First 32 bits of md5 as a share of 2^32: what ``hash_scorer`` gives."""
    return F.conv(F.substring(F.md5(prompt), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
