"""Calibration metrics against independent numpy/brute-force definitions."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.operators import calibration as cal


def np_ece(y, p, n=15):
    edges = [i * (1.0 / n) for i in range(n)] + [1.0]
    idx = np.searchsorted(np.array(edges), np.array(p), side="left") - 1
    total = 0.0
    for b in range(n):
        m = idx == b
        if m.sum():
            total += m.sum() / len(y) * abs(np.mean(np.array(p)[m]) - np.mean(np.array(y)[m]))
    return total


def pairwise_auroc(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_ece_edges_zero_and_one(spark):
    y = [1, 0, 1, 1, 0, 1]
    p = [0.0, 1.0, 1 / 15, 0.1, 0.5, 1.0]
    got = cal.ece(frame(spark, y, p), "y", "p").first()["ece"]
    assert abs(got - np_ece(y, p)) < 1e-12
    bins = {r["bin"]: r["n"] for r in cal.reliability_bins(frame(spark, y, p), "y", "p").collect()}
    assert -1 not in bins and sum(bins.values()) == 5  # p = 0 is in no bin but counts in N


def test_metrics_random_against_reference_definitions(spark):
    rng = random.Random(3)
    y = [rng.randint(0, 1) for _ in range(300)]
    p = [round(rng.random(), 2) for _ in range(300)]
    df = frame(spark, y, p)
    assert abs(cal.ece(df, "y", "p").first()[0] - np_ece(y, p)) < 1e-12
    assert abs(cal.brier(df, "y", "p").first()[0] - np.mean((np.array(p) - np.array(y)) ** 2)) < 1e-12
    pc = np.clip(p, 1e-15, 1 - 1e-15)
    ref_nll = -np.mean(np.array(y) * np.log(pc) + (1 - np.array(y)) * np.log(1 - pc))
    assert abs(cal.nll(df, "y", "p").first()[0] - ref_nll) < 1e-12
    assert abs(cal.auroc(df, "y", "p").first()[0] - pairwise_auroc(y, p)) < 1e-12


def test_auroc_single_class_is_null(spark):
    assert cal.auroc(frame(spark, [1, 1, 1], [0.1, 0.5, 0.9]), "y", "p").first()[0] is None


def test_auroc_invariant_under_repartition(spark):
    rng = random.Random(5)
    y = [rng.randint(0, 1) for _ in range(500)]
    p = [round(rng.random(), 1) for _ in range(500)]
    df = frame(spark, y, p)
    ref = pairwise_auroc(y, p)
    for n in (1, 7, 64):
        got = cal.auroc(df.repartition(n), "y", "p").first()[0]
        assert abs(got - ref) < 1e-12


def test_accuracy_divides_by_all_rows_and_all_abstain(spark):
    df = spark.createDataFrame([(1, True), (1, False), (0, False), (1, False)], "y int, a boolean")
    r = cal.accuracy_with_abstain(df, "y", "a").first()
    assert r["acc"] == 2 / 4 and r["na"] == 0.25
    df2 = spark.createDataFrame([(1, "c_raw", "No answer"), (0, "c_raw", "no answer here")],
                                "y int, c_raw string, y_pred string").withColumn("c_type", F.lit("ct"))
    r2 = cal.evaluate_predictions(df2).first()
    assert r2["acc"] == 0.0 and r2["na"] == 1.0 and r2["auroc"] is None


def test_class_weights_missing_class(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    w = {r["cls"]: r["weight"] for r in cal.class_weights(df, "y", 3).collect()}
    assert w == {0: 3 / (3 * 2), 1: 3 / (3 * 1), 2: 3 / (3 * 1)}


def test_softmax_sums_to_one_and_argmax_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "l array<double>")
    r = df.select(ar.softmax("l", 0.7).alias("p"), ar.argmax_class("l").alias("a")).first()
    assert abs(sum(r["p"]) - 1) < 1e-12 and r["a"] == 1


def test_multiclass_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(50, 4))
    y = rng.integers(0, 4, size=50)
    df = spark.createDataFrame([(l.tolist(), int(t)) for l, t in zip(logits, y)], "l array<double>, y int")
    r = cal.multiclass_metrics(df, "l", "y").first()
    pr = np.exp(logits - logits.max(1, keepdims=True))
    pr /= pr.sum(1, keepdims=True)
    assert abs(r["acc"] - np.mean(logits.argmax(1) == y)) < 1e-12
    assert abs(r["loss"] - np.mean(-np.log(pr[np.arange(50), y]))) < 1e-9
    assert abs(r["brier"] - np.mean(((pr - np.eye(4)[y]) ** 2).sum(1))) < 1e-12
    assert abs(r["ece"] - np_ece((logits.argmax(1) == y).astype(int), pr.max(1))) < 1e-12


def test_ece_is_at_most_one(spark):
    df = frame(spark, [0, 0, 1, 1], [1.0, 0.99, 0.01, 0.02])
    assert cal.ece(df, "y", "p").first()[0] <= 1.0


def test_auroc_matches_pairs(spark):
    rng = random.Random(8)
    y = [rng.randint(0, 1) for _ in range(400)]
    p = [rng.random() for _ in range(400)]  # all distinct: every score its own row
    got = cal.auroc(frame(spark, y, p), "y", "p").first()[0]
    assert abs(got - pairwise_auroc(y, p)) < 1e-12


def test_bundle_with_hot_dataset(spark):
    rng = random.Random(13)
    rows = []
    for i in range(900):
        ds_name = "hot" if i % 3 == 0 else f"d{i % 5}"
        rows.append((ds_name, rng.randint(0, 1), f"{round(rng.random() * 100, 1)} (0-100)", "ct",
                     "No answer" if i % 17 == 0 else "x"))
    df = spark.createDataFrame(rows, "dataset string, y int, c_raw string, c_type string, y_pred string")
    ref = {r.dataset: r for r in cal.evaluate_predictions(df, group=["dataset"]).collect()}
    got = {r.dataset: r for r in cal.evaluate_predictions(df.repartition(7), group=["dataset"]).collect()}
    for k, r in ref.items():
        for m in ["acc", "ece", "brier", "nll", "na", "auroc"]:
            assert abs(r[m] - got[k][m]) < 1e-12
    hot = [r for r in rows if r[0] == "hot" and r[4] != "No answer"]
    y = [r[1] for r in hot]
    p = [float(r[2].split(" (")[0]) / 100 for r in hot]
    assert abs(got["hot"]["auroc"] - pairwise_auroc(y, p)) < 1e-12


def test_zero_in_first_bin_flag(spark):
    y = [1, 0, 1]
    p = [0.0, 0.0, 0.5]
    df = frame(spark, y, p)
    bins = {r["bin"]: r["n"] for r in cal.reliability_bins(df, "y", "p", zero_in_first_bin=True).collect()}
    assert bins[0] == 2
    got = cal.ece(df, "y", "p", zero_in_first_bin=True).first()[0]
    assert abs(got - (2 / 3 * abs(0.0 - 0.5) + 1 / 3 * abs(0.5 - 1.0))) < 1e-12
    assert abs(cal.ece(df, "y", "p").first()[0] - 1 / 3 * 0.5) < 1e-12  # default: p = 0 in no bin
