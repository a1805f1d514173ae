"""Streaming (S) query: the calibration report kept by a Structured
Streaming aggregate over prediction files arriving one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.plans import fixtures as fx
from kestrel.plans.oracle import sql
from kestrel.plans.q_calibration import NLL_SQL, auroc_sql, ece_sql
from kestrel.plans.registry import query, r6
from kestrel.sources.io import scratch_path
from kestrel.streaming import calibration_stream as cs


@query("s1_streaming_calibration", sql(f"""
SELECT a.dataset, a.n, round(a.acc, 6) AS acc, e.ece, round(a.brier, 6) AS brier, round(a.nll, 6) AS nll
FROM (SELECT dataset, count(*) AS n, avg(y) AS acc, avg(pow(p - y, 2)) AS brier, {NLL_SQL.format(y='y', p='p')} AS nll
      FROM fx_preds GROUP BY dataset) a JOIN {ece_sql('fx_preds', 'dataset', 'y', 'p')} e USING (dataset)""", "fx_preds"))
def s1(spark, d):
    src = scratch_path(spark, "preds-stream")
    fx.preds(spark, d).select("dataset", "y", "p").repartition(4).write.parquet(src)
    name = f"kestrel_calib_{uuid.uuid4().hex[:8]}"
    q = cs.start_calibration_stream(spark, src, "dataset string, y int, p double",
                                    scratch_path(spark, "stream-ckpt"), name)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rep = cs.report(spark.table(name))
    return rep.select("dataset", "n", *[r6(c).alias(c) for c in ["acc", "ece", "brier", "nll"]])


@query("s2_streaming_report", sql(f"""
SELECT a.dataset, a.n, round(a.acc, 6) AS acc, e.ece, round(a.brier, 6) AS brier, round(a.nll, 6) AS nll, r.auroc
FROM (SELECT dataset, count(*) AS n, avg(y) AS acc, avg(pow(p - y, 2)) AS brier, {NLL_SQL.format(y='y', p='p')} AS nll
      FROM fx_preds GROUP BY dataset) a JOIN {ece_sql('fx_preds', 'dataset', 'y', 'p')} e USING (dataset)
  JOIN {auroc_sql('fx_preds', 'dataset', 'y', 'p')} r USING (dataset)""", "fx_preds"))
def s2(spark, d):
    """The whole bundle, AUROC included, after four files and a restart."""
    src, checkpoint, counts = (scratch_path(spark, x) for x in ("preds-stream", "stream-ckpt", "counts"))
    rows = fx.preds(spark, d).select("dataset", "y", "p")
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("dataset", "y", "p"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(src)
        q = cs.start_score_counts(spark, src, "dataset string, y int, p double", checkpoint, counts)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    rep = cs.counts_report(spark, counts)
    return rep.select("dataset", "n", *[r6(c).alias(c) for c in ["acc", "ece", "brier", "nll", "auroc"]])
