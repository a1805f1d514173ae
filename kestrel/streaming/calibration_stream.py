"""Running calibration report over arriving prediction files.

The reference grades directories of prediction files and reports metrics
per dataset. ACC, ECE (per-bin counts and sums), Brier and NLL are sums, so
the same report runs as a Structured Streaming aggregate: each new file
updates per-dataset partial sums held in Spark's state store, and the
report is derived from the sums. AUROC needs an order: ``start_score_counts``
keeps how often each score of a dataset came with each label, a state of its own for
every (dataset, score), and from these counts the whole batch bundle follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from kestrel.operators.calibration import EPS, _metrics_from_counts, bin_index, ece_aggs, ece_from_aggs
from kestrel.session import materialize

N_BINS = 15


def running_sums(stream: DataFrame, y: str = "y", p: str = "p", group: str = "dataset",
                 n_bins: int = N_BINS) -> DataFrame:
    pc = F.least(F.greatest(F.col(p).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    yc = F.col(y).cast("double")
    stream = stream.withColumn("_bin", bin_index(p, n_bins))
    return stream.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(yc).alias("s_y"),
        F.sum(F.pow(F.col(p).cast("double") - yc, 2)).alias("s_sq"),
        F.sum(-(yc * F.log(pc) + (1 - yc) * F.log(1 - pc))).alias("s_nll"),
        *ece_aggs(y, p, n_bins, bin_col="_bin"))


def report(sums: DataFrame, group: str = "dataset", n_bins: int = N_BINS) -> DataFrame:
    """Metrics from the running sums (batch DataFrame)."""
    return sums.select(group, "n", (F.col("s_y") / F.col("n")).alias("acc"),
                       ece_from_aggs(F.col("n"), n_bins).alias("ece"),
                       (F.col("s_sq") / F.col("n")).alias("brier"), (F.col("s_nll") / F.col("n")).alias("nll"))


def start_calibration_stream(spark: SparkSession, path: str, schema: str, checkpoint: str,
                             query_name: str, y: str = "y", p: str = "p", group: str = "dataset",
                             max_files_per_trigger: int = 1, state_partitions: int = 16) -> StreamingQuery:
    """Start the stream over parquet files under ``path``; the running sums
    land in the in-memory table ``query_name`` (complete mode).

    The state is one row per dataset, so the aggregate's state store gets
    ``state_partitions`` partitions (fixed in the checkpoint at first start)
    instead of the session's batch shuffle width."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(path))
    sums = running_sums(src, y, p, group)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return (sums.writeStream.outputMode("complete").format("memory").queryName(query_name)
                .option("checkpointLocation", checkpoint).start())
    finally:
        spark.conf.set(key, before)


def _counted(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Rows and positives of one score so far, told anew whenever they grow."""
    n, pos = state.get if state.exists else (0, 0)
    for part in parts:
        n, pos = n + int(part["n"].sum()), pos + int(part["pos"].sum())
    state.update((n, pos))
    yield pd.DataFrame({"dataset": [key[0]], "p": [key[1]], "cnt": [n], "pos": [pos]})


def start_score_counts(spark: SparkSession, path: str, schema: str, checkpoint: str, counts: str, y: str = "y", p: str = "p",
                       group: str = "dataset", max_files_per_trigger: int = 1, state_partitions: int = 16) -> StreamingQuery:
    """Start the stream over parquet files under ``path``; the counts by
    (dataset, score) that a trigger changes are appended under ``counts``. A restart from
    ``checkpoint`` goes on behind the files that are done; late files are counted when
    they come. Rows without a score or a label are left out."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    rows = src.select(F.col(group).cast("string").alias("dataset"), F.col(p).cast("double").alias("p"), F.col(y).cast("long").alias("pos"),
                      F.lit(1).cast("long").alias("n")).where("p is not null and pos is not null")
    kept = rows.groupBy("dataset", "p").applyInPandasWithState(
        _counted, "dataset string, p double, cnt long, pos long", "cnt long, pos long", "append", GroupStateTimeout.NoTimeout)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return kept.writeStream.outputMode("append").format("parquet").option("path", counts).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(key, before)


def counts_report(spark: SparkSession, counts: str, n_bins: int = N_BINS) -> DataFrame:
    """dataset, n, acc, ece, brier, nll, auroc from the latest counts. A
    score's count only grows, so its latest state is the greatest."""
    rows = spark.read.schema("dataset string, p double, cnt long, pos long").parquet(counts)
    latest = rows.groupBy("dataset", F.col("p").alias("_p")).agg(F.max(F.struct("cnt", "pos")).alias("s"))
    table = materialize(latest.select("dataset", "_p", "s.cnt", "s.pos"))
    return _metrics_from_counts(table, ["dataset"], n_bins, None).select(
        "dataset", F.col("_all").alias("n"), "acc", "ece", "brier", "nll", "auroc")
