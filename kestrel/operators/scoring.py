"""Batched model-call stage.

Every generate/grade loop of the reference has one shape: many rows share
prompts, a model scores prompts in batches, results are cached. Here:
dedupe prompts → ``left_anti`` against the result cache → Arrow-batched
``mapInPandas`` over the remaining prompts → append to the cache → join the
scores back to every row. The scorer is any ``pandas.Series → Series``
callable (a model client, a local model, or a deterministic stand-in).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stage(df: DataFrame, prompt: str, scorer: Callable[[pd.Series], pd.Series],
                out: str = "score", cache_path: str | None = None) -> DataFrame:
    """``df`` plus ``out``: the scorer's value of each prompt. Null prompts are
    not scored (null). A cache with repeated keys (an append that ran twice)
    counts each key once."""
    spark = df.sparkSession
    prompts = (df.where(F.col(prompt).isNotNull()).select(F.md5(F.col(prompt)).alias("pkey"), F.col(prompt).alias("prompt"))
               .dropDuplicates(["pkey"]))
    if cache_path and _exists(spark, cache_path):
        prompts = prompts.join(spark.read.parquet(cache_path).select("pkey"), "pkey", "left_anti")

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            yield pd.DataFrame({"pkey": pdf["pkey"], "score": scorer(pdf["prompt"]).astype("float64")})

    fresh = prompts.mapInPandas(fn, "pkey string, score double")
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
        scores = spark.read.parquet(cache_path).groupBy("pkey").agg(F.min("score").alias("score"))
    else:
        scores = fresh
    keyed = df.withColumn("_pkey", F.md5(F.col(prompt)))
    return keyed.join(scores.select(F.col("pkey").alias("_pkey"), F.col("score").alias(out)), "_pkey", "left").drop("_pkey")


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def hash_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in scorer: first 32 bits of md5(prompt) / 2^32."""
    import hashlib

    return prompts.map(lambda p: int(hashlib.md5(p.encode("utf-8")).hexdigest()[:8], 16) / 4294967296.0)
