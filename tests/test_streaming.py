"""The streaming calibration report equals the batch report."""

import random


from kestrel.operators import calibration as cal
from kestrel.streaming import calibration_stream as cs


def test_stream_matches_batch(spark, tmp_path):
    rng = random.Random(21)
    rows = [(["a", "b", "c"][i % 3], rng.randint(0, 1), round(rng.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "dataset string, y int, p double")
    src = str(tmp_path / "src")
    df.repartition(5).write.parquet(src)  # five files arrive one per trigger
    q = cs.start_calibration_stream(spark, src, "dataset string, y int, p double", str(tmp_path / "ckpt"), "calib_test")
    try:
        q.processAllAvailable()
        assert q.lastProgress is not None
    finally:
        q.stop()
    got = {r.dataset: r for r in cs.report(spark.table("calib_test")).collect()}
    ref = {r.dataset: r for r in cal.calibration_report(df, "y", "p", ["dataset"]).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        assert got[k]["n"] == ref[k]["n"]
        for m in ["acc", "ece", "brier", "nll"]:
            assert abs(got[k][m] - ref[k][m]) < 1e-12


def test_report_follows_every_file(spark, tmp_path):
    """One file at a time, the stream stopped and started in between; after
    each file the report is the batch bundle of what came so far."""
    rng = random.Random(5)
    src, checkpoint, counts = (str(tmp_path / x) for x in ("src", "ckpt", "counts"))
    rows = []
    for i in range(3):
        new = [("ab"[rng.randrange(2)], rng.randint(0, 1), round(rng.random(), 1)) for _ in range(50)] + [("late", 1, 0.5)] * (i == 2) + [("a", 1, None)]
        rows += new
        spark.createDataFrame(new, "dataset string, y int, p double").coalesce(1).write.mode("append").parquet(src)
        q = cs.start_score_counts(spark, src, "dataset string, y int, p double", checkpoint, counts, state_partitions=2)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        scored = spark.createDataFrame([r for r in rows if r[2] is not None], "dataset string, y int, p double")
        want = {r.dataset: r for r in cal.calibration_report(scored, "y", "p", ["dataset"]).collect()}
        got = {r.dataset: r for r in cs.counts_report(spark, counts).collect()}
        assert got.keys() == want.keys()
        for d, w in want.items():
            for m in ("n", "acc", "ece", "brier", "nll", "auroc"):
                assert got[d][m] == w[m] or abs(got[d][m] - w[m]) < 1e-12, (i, d, m)
