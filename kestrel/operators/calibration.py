"""Calibration and quality metrics (G1–G16, F6 row reduction).

All metrics are ``groupBy(group…)`` aggregates. Wherever a metric is
additive it is written as a single ``agg`` (partial aggregation map-side,
one tiny shuffle of per-group partials). Only AUROC needs an order; it is
computed from per-(group, distinct score) counts with the two-level prefix
sum of ``kestrel.operators.ordering`` — no single-partition window even when
one group holds most rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.functions import text as tx
from kestrel.operators.ordering import dense_index, prefix_sums
from kestrel.session import join_null_safe, materialize

EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bin_edges(n_bins: int) -> list[float]:
    """Edges of n equal bins of [0, 1]: i·(1/n), the last edge exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(p, n_bins: int, zero_in_first_bin: bool = False) -> Column:
    """Bin i holds (edge_i, edge_{i+1}]; p <= 0 gives -1 and p > 1 gives n
    (both outside every bin). ``zero_in_first_bin`` puts p = 0 into bin 0
    (the surveyed behaviour drops it, so the default keeps parity)."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    pc = _c(p).cast("double")
    b = (F.size(F.filter(edges, lambda e: e < pc)) - 1).cast("int")
    if zero_in_first_bin:
        b = F.when(pc == 0, F.lit(0)).otherwise(b)
    return b


# ---------------------------------------------------------------------------
# G1 / G2
# ---------------------------------------------------------------------------

def reliability_bins(df: DataFrame, y: str, p: str, n_bins: int = 15,
                     group: list[str] | None = None, zero_in_first_bin: bool = False) -> DataFrame:
    """(group…, bin, n, mean_p, mean_y) for the bins that hold rows."""
    group = list(group or [])
    b = df.select(*group, bin_index(p, n_bins, zero_in_first_bin).alias("bin"), F.col(p).cast("double").alias("_p"),
                  F.col(y).cast("double").alias("_y"))
    return (b.where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
            .groupBy(*group, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_p"), F.avg("_y").alias("mean_y")))


def ece_aggs(y, p, n_bins: int = 15, prefix: str = "", bin_col=None) -> list[Column]:
    """Per-bin partial sums as plain aggregate columns (one pass).

    Pass ``bin_col`` (a column holding ``bin_index(p)`` projected before the
    aggregate) so the bin is computed once per row, not once per bin."""
    b = _c(bin_col) if bin_col is not None else bin_index(p, n_bins)
    pc, yc = _c(p).cast("double"), _c(y).cast("double")
    out = []
    for i in range(n_bins):
        hit = b == i
        out += [F.sum(F.when(hit, 1).otherwise(0)).alias(f"{prefix}_bn{i}"),
                F.sum(F.when(hit, pc)).alias(f"{prefix}_bp{i}"),
                F.sum(F.when(hit, yc)).alias(f"{prefix}_by{i}")]
    return out


def ece_from_aggs(total: Column, n_bins: int = 15, prefix: str = "") -> Column:
    """Σ_b n_b/N · |mean_p_b − mean_y_b| from the ``ece_aggs`` columns;
    N counts every row, including those outside all bins."""
    terms = []
    for i in range(n_bins):
        n = F.col(f"{prefix}_bn{i}")
        terms.append(F.when(n > 0, n / total * F.abs(F.col(f"{prefix}_bp{i}") / n
                                                     - F.col(f"{prefix}_by{i}") / n)).otherwise(0.0))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def ece(df: DataFrame, y: str, p: str, n_bins: int = 15, group: list[str] | None = None,
        zero_in_first_bin: bool = False) -> DataFrame:
    group = list(group or [])
    x = df.withColumn("_bin", bin_index(p, n_bins, zero_in_first_bin))
    agg = x.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *ece_aggs(y, p, n_bins, bin_col="_bin"))
    return agg.select(*group, ece_from_aggs(F.col("_n"), n_bins).alias("ece"))


# ---------------------------------------------------------------------------
# G3 / G5 / G6
# ---------------------------------------------------------------------------

def brier_col(y, p) -> Column:
    return F.avg(F.pow(_c(p).cast("double") - _c(y).cast("double"), 2))


def nll_col(y, p) -> Column:
    pc = F.least(F.greatest(_c(p).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    yc = _c(y).cast("double")
    return -F.avg(yc * F.log(pc) + (1 - yc) * F.log(1 - pc))


def brier(df, y, p, group=None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(brier_col(y, p).alias("brier"))


def nll(df, y, p, group=None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(nll_col(y, p).alias("nll"))


def accuracy_with_abstain(df: DataFrame, y: str, abstain: str, group=None) -> DataFrame:
    """acc = correct among answered rows / all rows; na = abstain rate."""
    a = F.col(abstain).cast("boolean")
    return df.groupBy(*(group or [])).agg(
        (F.sum(F.when(~a, F.col(y)).otherwise(0)) / F.count(F.lit(1))).alias("acc"),
        F.avg(a.cast("double")).alias("na"))


# ---------------------------------------------------------------------------
# G4 AUROC
# ---------------------------------------------------------------------------

def auroc(df: DataFrame, y: str, p: str, group: list[str] | None = None) -> DataFrame:
    """Area under ROC with half credit for ties; null for a single class.

    Σ_v neg_v · (pos_{>v} + pos_v / 2) / (P · N), from per-(group, score)
    counts and an exclusive prefix sum of positives in descending score.
    """
    group = list(group or [])
    counts = (df.select(*group, F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"))
              .groupBy(*group, "_p")
              .agg(F.sum("_y").cast("long").alias("pos"), F.sum(1 - F.col("_y")).cast("long").alias("neg")))
    cum = prefix_sums(counts, [F.col("_p").desc()], ["pos"], group, prefix="above_", inclusive=False)
    area = cum.groupBy(*group).agg(
        F.sum(F.col("neg") * (F.col("above_pos") + F.col("pos") / 2.0)).alias("_a"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return area.select(*group, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                      F.col("_a") / (F.col("_P") * F.col("_N"))).alias("auroc"))


# ---------------------------------------------------------------------------
# G7 bundle
# ---------------------------------------------------------------------------

def score_counts(x: DataFrame, group: list[str], y: str = "_y", p: str = "_p",
                 kept: str | None = None) -> DataFrame:
    """Sufficient statistics of every binary calibration metric: one row per
    (group…, [kept,] score) with ``cnt`` rows and ``pos`` positives. One pass
    over the (possibly costly) input, partial aggregation map-side."""
    keys = [*group, *([kept] if kept else []), p]
    return x.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("cnt"),
                                F.sum(F.col(y).cast("long")).cast("long").alias("pos"))


def _metrics_from_counts(c: DataFrame, group: list[str], n_bins: int, kept: str | None,
                         zero_in_first_bin: bool = False) -> DataFrame:
    """acc over all rows, na rate, and brier / nll / ece / auroc over kept
    rows with a score (``kept`` = None: every row counts)."""
    k = F.col(kept) if kept else F.lit(True)
    pc = F.col("_p")
    neg = F.col("cnt") - F.col("pos")
    scored = k & pc.isNotNull()
    clip = F.least(F.greatest(pc, F.lit(EPS)), F.lit(1 - EPS))
    b = bin_index(pc, n_bins, zero_in_first_bin)
    c = c.withColumn("_bin", F.when(scored, b))
    aggs = [F.sum("cnt").alias("_all"), F.sum(F.when(k, F.col("cnt")).otherwise(0)).alias("_kept"),
            F.sum(F.when(k, F.col("pos")).otherwise(0)).alias("_correct"),
            F.sum(F.when(scored, F.col("cnt")).otherwise(0)).alias("_scored"),
            F.sum(F.when(scored, F.col("pos") * F.pow(pc - 1, 2) + neg * F.pow(pc, 2))).alias("_sq"),
            F.sum(F.when(scored, -(F.col("pos") * F.log(clip) + neg * F.log(1 - clip)))).alias("_nl")]
    for i in range(n_bins):
        hit = F.col("_bin") == i
        aggs += [F.sum(F.when(hit, F.col("cnt")).otherwise(0)).alias(f"_bn{i}"),
                 F.sum(F.when(hit, pc * F.col("cnt"))).alias(f"_bp{i}"),
                 F.sum(F.when(hit, F.col("pos").cast("double"))).alias(f"_by{i}")]
    one = c.groupBy(*group).agg(*aggs)
    rep = one.select(*group, "_all", "_kept", (F.col("_correct") / F.col("_all")).alias("acc"),
                     ece_from_aggs(F.col("_kept"), n_bins).alias("ece"),
                     (F.col("_sq") / F.col("_scored")).alias("brier"), (F.col("_nl") / F.col("_scored")).alias("nll"),
                     ((F.col("_all") - F.col("_kept")) / F.col("_all")).alias("na"))
    sc = c.where(scored).groupBy(*group, "_p").agg(F.sum("pos").alias("pos"), F.sum(neg).alias("neg"))
    cum = prefix_sums(sc, [F.col("_p").desc()], ["pos"], group, prefix="above_", inclusive=False)
    area = cum.groupBy(*group).agg(
        F.sum(F.col("neg") * (F.col("above_pos") + F.col("pos") / 2.0)).alias("_a"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    au = area.select(*group, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                    F.col("_a") / (F.col("_P") * F.col("_N"))).alias("auroc"))
    return join_null_safe(rep, au, group, "left")


def evaluate_predictions(df: DataFrame, y: str = "y", c_raw: str = "c_raw", c_type: str = "c_type",
                         y_pred: str = "y_pred", group: list[str] | None = None,
                         n_bins: int = 15, zero_in_first_bin: bool = False) -> DataFrame:
    """auroc, acc, ece, brier, nll, na per group.

    Abstained rows ('no answer' in the prediction) leave every metric but
    accuracy, whose divisor is all rows. The input is read once into
    per-(group, abstained, score) counts (written to the checkpoint folder);
    every metric, AUROC included, derives from that table.
    """
    ungrouped = not group
    group = list(group or ["_all_"])
    if ungrouped:
        df = df.withColumn("_all_", F.lit(1))
    x = df.select(*group, F.col(y).cast("int").alias("_y"),
                  tx.parse_confidence(c_raw, c_type).alias("_p"),
                  (~tx.is_abstain(y_pred)).alias("_kept"))
    counts = materialize(score_counts(x, group, kept="_kept"))
    out = _metrics_from_counts(counts, group, n_bins, "_kept", zero_in_first_bin).select(
        *group, "acc", "ece", "brier", "nll", "na", "auroc")
    return out.drop("_all_") if ungrouped else out


# ---------------------------------------------------------------------------
# G8 – G11 multiclass / soft-label metrics
# ---------------------------------------------------------------------------

def multiclass_metrics(df: DataFrame, logits: str, y: str, n_bins: int = 15, group=None) -> DataFrame:
    """N, acc, loss (mean CE), brier (multiclass), ece (top-1)."""
    group = list(group or [])
    probs = ar.softmax(logits)
    x = df.select(*group, F.col(logits).cast("array<double>").alias("_l"), F.col(y).cast("int").alias("_y"),
                  probs.alias("_pr"))
    yy = F.col("_y")
    pred = ar.argmax_class("_l")
    conf = F.array_max("_pr")
    sq = F.aggregate(F.transform("_pr", lambda v, i: F.pow(v - F.when(i == yy, 1.0).otherwise(0.0), 2)),
                     F.lit(0.0).cast("double"), lambda a, v: a + v)
    ce = ar.logsumexp("_l") - F.element_at("_l", yy + 1)
    x = x.select(*group, pred.alias("_pred"), yy, conf.alias("_conf"), sq.alias("_sq"), ce.alias("_ce"))
    x = x.withColumn("_bin", bin_index("_conf", n_bins))
    correct = (F.col("_pred") == yy).cast("double")
    agg = x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct).alias("acc"), F.avg("_ce").alias("loss"),
        F.avg("_sq").alias("brier"), *ece_aggs(correct, F.col("_conf"), n_bins, bin_col="_bin"))
    return agg.select(*group, "n", "acc", "loss", "brier", ece_from_aggs(F.col("n"), n_bins).alias("ece"))


def soft_label_metrics(df: DataFrame, logits: str, s: str, n_bins: int = 15, group=None) -> DataFrame:
    """Two-class head against a vote label s∈0..10: target = [s/10, 1 − s/10]."""
    group = list(group or [])
    v = F.col(s).cast("double") / 10.0
    x = df.select(*group, F.col(logits).cast("array<double>").alias("_l"), v.alias("_v"))
    pr = ar.softmax("_l")
    x = x.select(*group, "_l", "_v", pr.alias("_pr"))
    t0, t1 = F.col("_v"), 1 - F.col("_v")
    p0, p1 = F.element_at("_pr", 1), F.element_at("_pr", 2)
    lse = ar.logsumexp("_l")
    lp0, lp1 = F.element_at("_l", 1) - lse, F.element_at("_l", 2) - lse
    pred = ar.argmax_class("_l")
    target_cls = F.when(t0 >= t1, 0).otherwise(1)  # ties go to class 0
    conf = F.array_max("_pr")
    corr = F.when(pred == 0, t0).otherwise(t1)
    x = x.withColumn("_bin", bin_index(conf, n_bins))
    agg = x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((pred == target_cls).cast("double")).alias("acc"),
        F.avg(-(t0 * lp0 + t1 * lp1)).alias("loss"),
        F.avg(F.pow(p0 - t0, 2) + F.pow(p1 - t1, 2)).alias("brier"),
        *ece_aggs(corr, conf, n_bins, bin_col="_bin"))
    return agg.select(*group, "n", "acc", "loss", "brier", ece_from_aggs(F.col("n"), n_bins).alias("ece"))


def label_subset_metrics(df: DataFrame, logits: str, y: str, label_ids: list[int], group=None) -> DataFrame:
    """N, accuracy and cross-entropy over the logits of ``label_ids`` only."""
    sub = F.array(*[F.element_at(F.col(logits).cast("array<double>"), i + 1) for i in label_ids])
    x = df.select(*(group or []), sub.alias("_sub"), F.col(y).cast("int").alias("_y"))
    return multiclass_metrics(x, "_sub", "_y", group=group).select(*(group or []), "n", "acc", "loss")


# ---------------------------------------------------------------------------
# G12 / G13 / G14
# ---------------------------------------------------------------------------

def weighted_average(df: DataFrame, name: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(name).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"),
        F.sum(weight).alias("weight"))


def class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """weight_c = total / (C · count_c); a missing class counts as 1. The
    total is of all labelled rows, also those outside 0..C-1."""
    y = F.col(label).cast("int")
    counts = [F.count(F.when(y == c, 1)) for c in range(n_classes)]
    one = df.agg(F.count(y).alias("_total"), F.array(*counts).alias("_counts"))
    x = one.select("_total", F.posexplode("_counts").alias("cls", "cnt"))
    return x.select("cls", (F.col("_total") / (F.lit(n_classes) * F.greatest("cnt", F.lit(1)))).alias("weight"))


def embedding_spread(df: DataFrame, vec: str, group=None, dim: int | None = None) -> DataFrame:
    """Mean over dimensions of the per-dimension sample std (n − 1); null for
    a single vector. One vector aggregate, whatever the number of dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    group = list(group or [])
    rows = df.where(F.col(vec).isNotNull()).select(*group, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    g = rows.groupBy(*group).agg(Summarizer.metrics("std", "count").summary(F.col("_v")).alias("_s"))
    std = vector_to_array(F.col("_s.std"))
    mean = F.aggregate(std, F.lit(0.0), lambda a, x: a + x) / F.size(std)
    return g.select(*group, F.when(F.col("_s.count") > 1, mean).alias("spread"))


DIVERGENCES = ("reverse_kl", "forward_kl", "jsd")


def divergence(df: DataFrame, row: str, p: str, ref: str, label: str, kinds: tuple[str, ...] = DIVERGENCES) -> DataFrame:
    """(kind, value): per position the divergence of ``p`` from ``ref``, 0
    where the label is -100, summed over a row's positions, averaged over
    rows. One pass for all kinds."""
    kept = F.col(label) != ar.IGNORE_LABEL
    per_row = df.groupBy(row).agg(*[F.sum(F.when(kept, ar.divergence(p, ref, k)).otherwise(0.0)).alias(k) for k in kinds])
    one = per_row.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.avg(k).alias("value")) for k in kinds]).alias("all"))
    return one.select(F.inline("all"))


# ---------------------------------------------------------------------------
# G15 in-batch contrast, G16 queue contrast
# ---------------------------------------------------------------------------

BLOCK_ROWS = 1024  # rows of a block of vectors; no task holds more than two blocks


def _blocks(df: DataFrame, keys: list[str], cols: list, salt: str) -> DataFrame:
    """Rows of each key bundled into blocks of about ``BLOCK_ROWS``."""
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_n"))
    dealt = join_null_safe(df, n, keys).withColumn("_blk", F.pmod(F.xxhash64(F.lit(salt), *cols), F.col("_n")))
    return dealt.groupBy(*keys, "_blk").agg(F.collect_list(F.struct(*cols)).alias(salt))


def _score_blocks(temperature: float):
    """Query block × key block: per query the running maximum, the sum of
    exponentials below it, the sum and count of scores, the first best key and
    the score of its own key (null if not in this block)."""
    def fn(batches):
        for pdf in batches:
            for batch, qs, ks in zip(pdf["_b"], pdf["qs"], pdf["ks"]):
                q = np.array([x["v"] for x in qs], np.float64)
                rows = np.array([x["r"] for x in qs])
                keys = np.array([x["r"] for x in ks])
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                s = q @ np.array([x["v"] for x in ks], np.float64)[order].T / temperature
                m = s.max(axis=1)
                at = np.searchsorted(keys, rows)
                own = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == rows)
                mine = np.where(own, s[np.arange(len(rows)), np.minimum(at, len(keys) - 1)], np.nan)
                yield pd.DataFrame({"_b": batch, "_r": rows, "m": m, "e": np.exp(s - m[:, None]).sum(axis=1), "t": s.sum(axis=1),
                                    "n": s.shape[1], "best": keys[s.argmax(axis=1)], "own": [None if np.isnan(x) else float(x) for x in mine]})
    return fn


def _combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of one query to its log-sum-exp, mean, best key and own score."""
    top = F.max(F.struct("m", (-F.col("best")).alias("b")))
    g = parts.groupBy(*keys).agg(top.alias("_top"), F.collect_list(F.struct("m", "e")).alias("_me"), F.sum("t").alias("_t"),
                                 F.sum("n").alias("_n"), F.max("own").alias("_own"))
    lse = F.col("_top.m") + F.log(F.aggregate("_me", F.lit(0.0), lambda a, x: a + x["e"] * F.exp(x["m"] - F.col("_top.m"))))
    return g.select(*keys, lse.alias("_lse"), (F.col("_t") / F.col("_n")).alias("_mean"), (-F.col("_top.b")).alias("_best"), "_own")


def inbatch_contrast(df: DataFrame, batch: str, row: str, q: str, k: str,
                     temperature: float = 1.0, label_smoothing: float = 0.0) -> DataFrame:
    """Per batch: each query scores every key of its batch; accuracy (own key
    is the arg-max, smallest row on ties) and cross-entropy with label
    smoothing. Queries and keys of a batch are met block by block with one
    matmul each; blocks are combined by maximum and sum, so a batch may have
    any size. ``row`` must be an integer, unique in its batch."""
    src = df.select(F.col(batch).alias("_b"), F.col(row).cast("long").alias("r"), F.col(q).cast("array<double>").alias("_q"),
                    F.col(k).cast("array<double>").alias("_k"))
    qs = _blocks(src, ["_b"], [F.col("r"), F.col("_q").alias("v")], "qs")
    ks = _blocks(src, ["_b"], [F.col("r"), F.col("_k").alias("v")], "ks")
    pairs = join_null_safe(qs.select("_b", "qs"), ks.select("_b", "ks"), ["_b"])
    kind = src.schema["_b"].dataType.simpleString()
    parts = pairs.mapInPandas(_score_blocks(temperature),
                              f"_b {kind}, _r long, m double, e double, t double, n long, best long, own double")
    x = _combine(parts, ["_b", "_r"])
    ce = (1 - label_smoothing) * (F.col("_lse") - F.col("_own")) + label_smoothing * (F.col("_lse") - F.col("_mean"))
    return x.select(F.col("_b").alias(batch), F.col("_r").cast(df.schema[row].dataType).alias(row),
                    (F.col("_best") == F.col("_r")).cast("double").alias("hit"), ce.alias("loss"))


def queue_contrast(df: DataFrame, q: str, k: str, queue: DataFrame, qvec: str,
                   temperature: float = 1.0, label_smoothing: float = 0.0) -> DataFrame:
    """logits = [q·k, q·queue_j …] / T with label 0, per row: hit, loss.

    Query rows meet the queue in blocks of ``BLOCK_ROWS`` with one matmul
    each; blocks are combined by maximum and sum. Nothing reaches the driver
    and the queue may have any size."""
    src = df.select(F.lit(0).alias("_b"), F.col("row_id").cast("long").alias("r"), F.col(q).cast("array<double>").alias("_q"),
                    F.col(k).cast("array<double>").alias("_k"))
    bank = queue.select(F.lit(0).alias("_b"), F.monotonically_increasing_id().alias("r"), F.col(qvec).cast("array<double>").alias("_v"))
    qs = _blocks(src, ["_b"], [F.col("r"), F.col("_q").alias("v")], "qs")
    ks = _blocks(bank, ["_b"], [F.col("_v").alias("v"), F.lit(-1).cast("long").alias("r")], "ks")
    parts = qs.select("_b", "qs").join(ks.select(F.col("_b").alias("_kb"), "ks"), F.col("_b") == F.col("_kb")).drop("_kb")
    parts = parts.mapInPandas(_score_blocks(temperature), "_b int, _r long, m double, e double, t double, n long, best long, own double")
    own = src.select(F.col("r").alias("_r"), (ar.dot("_q", "_k") / temperature).alias("s"))
    first = own.select(F.lit(0).alias("_b"), "_r", F.col("s").alias("m"), F.lit(1.0).alias("e"), F.col("s").alias("t"),
                       F.lit(1).cast("long").alias("n"), F.lit(-2).cast("long").alias("best"), F.col("s").alias("own"))
    x = _combine(parts.unionByName(first), ["_r"])
    ce = (1 - label_smoothing) * (F.col("_lse") - F.col("_own")) + label_smoothing * (F.col("_lse") - F.col("_mean"))
    return x.select(F.col("_r").alias("row_id"), (F.col("_best") == -2).cast("double").alias("hit"), ce.alias("loss"))


def _score_window(temperature: float):
    """Query rows of a batch × a block of keys, of which those at positions
    ``lo`` to ``hi`` - 1 count."""
    def fn(batches):
        for pdf in batches:
            for lo, hi, qs, ks in zip(pdf["lo"], pdf["hi"], pdf["qs"], pdf["ks"]):
                keys = [x["v"] for x in ks if lo <= x["p"] < hi]
                if keys:
                    s = np.array([x["v"] for x in qs], np.float64) @ np.array(keys, np.float64).T / temperature
                    m = s.max(axis=1)
                    yield pd.DataFrame({"_r": [x["r"] for x in qs], "m": m, "e": np.exp(s - m[:, None]).sum(axis=1), "t": s.sum(axis=1),
                                        "n": s.shape[1], "best": -1, "own": [None] * len(m)}).astype({"own": "float64"})
    return fn


def moving_queue_contrast(df: DataFrame, batch: str, row: str, q: str, k: str, size: int, temperature: float = 1.0,
                          label_smoothing: float = 0.0, block: int = BLOCK_ROWS) -> DataFrame:
    """As ``queue_contrast`` with the queue that moves along: a batch meets
    its own key and the last ``size`` keys of the batches before it (fewer at the
    start; none in the first batch). Keys lie in blocks by their position, and a batch
    is joined with the blocks that its window overlaps only."""
    src = df.select(F.col(batch).alias("b"), F.col(row).cast("long").alias("r"), F.col(q).cast("array<double>").alias("_q"),
                    F.col(k).cast("array<double>").alias("_k"))
    placed = materialize(dense_index(src, ["b", "r"], out="p").withColumn("blk", F.floor(F.col("p") / block)))
    keys = placed.groupBy("blk").agg(F.collect_list(F.struct("p", F.col("_k").alias("v"))).alias("ks"))
    asked = placed.groupBy("b", "blk").agg(F.collect_list(F.struct("r", F.col("_q").alias("v"))).alias("qs")).drop("blk")
    window = placed.groupBy("b").agg(F.min("p").alias("hi")).withColumn("lo", F.greatest(F.col("hi") - size, F.lit(0))).where("hi > 0")
    needs = window.withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    met = join_null_safe(asked, needs, ["b"]).join(keys, "blk").select("lo", "hi", "qs", "ks")
    parts = met.mapInPandas(_score_window(temperature), "_r long, m double, e double, t double, n long, best long, own double")
    own = placed.select(F.col("r").alias("_r"), (ar.dot("_q", "_k") / temperature).alias("s"))
    first = own.select("_r", F.col("s").alias("m"), F.lit(1.0).alias("e"), F.col("s").alias("t"), F.lit(1).cast("long").alias("n"),
                       F.lit(-2).cast("long").alias("best"), F.col("s").alias("own"))
    x = _combine(parts.unionByName(first), ["_r"])
    ce = (1 - label_smoothing) * (F.col("_lse") - F.col("_own")) + label_smoothing * (F.col("_lse") - F.col("_mean"))
    return x.select(F.col("_r").alias(row), (F.col("_best") == -2).cast("double").alias("hit"), ce.alias("loss"))


def calibration_report(df: DataFrame, y: str, p: str, group: list[str] | None = None,
                       n_bins: int = 15, zero_in_first_bin: bool = False) -> DataFrame:
    """n, acc, ece, brier, nll, auroc per group for numeric confidences — one
    read of the input into per-(group, score) counts, metrics from those."""
    ungrouped = not group
    group = list(group or ["_all_"])
    if ungrouped:
        df = df.withColumn("_all_", F.lit(1))
    x = df.select(*group, F.col(y).cast("int").alias("_y"), F.col(p).cast("double").alias("_p"))
    counts = materialize(score_counts(x, group))
    out = _metrics_from_counts(counts, group, n_bins, None, zero_in_first_bin).select(
        *group, F.col("_all").alias("n"), "acc", "ece", "brier", "nll", "auroc")
    return out.drop("_all_") if ungrouped else out
