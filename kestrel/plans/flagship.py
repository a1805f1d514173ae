"""Flagship plan: one real answer end to end.

documents + benchmark → BM25 top-k → contexts → attempts (one per context
and temperature, hashed confidence) → temperature ensemble → threshold-stop
rerank → grade the chosen passage by answer containment → calibration report
per language of the chosen passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import calibration as cal
from kestrel.operators import ireval as ev
from kestrel.operators import rerank as rr
from kestrel.plans import fixtures as fx


def flagship(spark: SparkSession, d: str, k: int = fx.RUN_DEPTH, top_k: int = 20, threshold: float = 0.6) -> DataFrame:
    run = fx.run(spark, d, k)
    attempts = fx.attempts(spark, d)
    mean = attempts.groupBy("qid", "rank").agg(F.round(F.avg("c"), 9).alias("c"), F.round(F.avg("prob"), 9).alias("prob"))
    best = rr.threshold_stop(mean, threshold=threshold, top_k=top_k)
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "lang", "text")
    q = fx.queries(spark, d).select("qid", F.array("answer").alias("answers"))
    chosen = (best.join(run.select("qid", "rank", "pid"), ["qid", "rank"])
              .join(docs, "pid").join(q, "qid"))
    graded = ev.has_answer(chosen, "text", "answers", out="correct")
    rep = cal.calibration_report(graded, "correct", "c", ["lang"])
    return rep.select(F.col("lang").alias("dataset"), "n", *[F.round(c, 6).alias(c) for c in
                                                             ["acc", "ece", "brier", "nll", "auroc"]])
