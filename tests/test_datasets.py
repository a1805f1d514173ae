"""Training-table invariants and the two-level ordering helpers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators import datasets as ds
from kestrel.operators.ordering import dense_index, prefix_sums


def test_dense_index_matches_row_number_with_hot_group(spark):
    # one group holds a third of all rows
    rows = [(0 if i % 3 == 0 else i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, k long")
    got = {(r.g, r.k): r.idx for r in dense_index(df, [F.col("k")], ["g"], n_ranges=9).collect()}
    w = Window.partitionBy("g").orderBy("k")
    exp = {(r.g, r.k): r.i for r in df.select("g", "k", (F.row_number().over(w) - 1).alias("i")).collect()}
    assert got == exp


def test_prefix_sums_descending(spark):
    df = spark.createDataFrame([(float(i % 10), 1) for i in range(100)], "p double, v long")
    # distinct order keys only (counts grouped first, as AUROC does)
    g = df.groupBy("p").agg(F.sum("v").alias("v"))
    out = {r.p: r.above_v for r in prefix_sums(g, [F.col("p").desc()], ["v"], prefix="above_", inclusive=False).collect()}
    assert out[9.0] == 0 and out[0.0] == 90


def test_split_exact_disjoint_and_exact(spark):
    df = spark.range(1001).withColumnRenamed("id", "doc_id")
    s = ds.split_exact(df, "doc_id", 0.2, seed=4)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c["test"] == 200 and c["train"] == 801
    assert s.select("doc_id").distinct().count() == 1001


def test_shuffle_is_partitioning_invariant(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k: r.pos for r in ds.shuffle(df.repartition(1), "k", 9).collect()}
    b = {r.k: r.pos for r in ds.shuffle(df.repartition(13), "k", 9).collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def test_pack_chunks_reconcatenate_prefix(spark):
    rows = [(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate([5, 0, 17, 3, 40, 1, 9])]
    df = spark.createDataFrame(rows, "k long, t array<int>")
    flat = [x for _, t in rows for x in t]
    L, off = 8, 3
    chunks = sorted((r.chunk_id, r.tokens) for r in ds.pack_chunks(df, "k", "t", L, off).collect())
    n_full = (len(flat) - off) // L
    assert [c for c, _ in chunks] == list(range(n_full))
    assert [x for _, t in chunks for x in t] == flat[off:off + n_full * L]
    assert all(len(t) == L for _, t in chunks)  # the short tail is dropped


def test_schedule_join_mismatch_raises(spark):
    rows = spark.range(10).withColumnRenamed("id", "i")
    temps = spark.createDataFrame([(0, 1.0), (1, 1.1)], "t_idx long, temperature double")
    with pytest.raises(ValueError):
        ds.schedule_join(rows, [F.col("i")], temps, 3)
    ok = ds.schedule_join(rows, [F.col("i")], temps, 5)
    got = {r.i: r.temperature for r in ok.collect()}
    assert got[4] == 1.0 and got[5] == 1.1


def test_augment_modes(spark):
    df = spark.createDataFrame([(1, list(range(200)))], "k long, t array<int>")
    r = df.select(*[ds.augment_tokens("t", m, 0.3, 1, F.col("k"), mask_id=-1).alias(m)
                    for m in ["delete", "mask", "replace", "shuffle"]]).first()
    assert 100 < len(r["delete"]) < 180
    assert r["mask"].count(-1) == 200 - len(r["delete"])  # same draws decide both
    assert len(r["replace"]) == 200
    assert sorted(r["shuffle"]) == list(range(200)) and r["shuffle"] != list(range(200))


def test_soft_rows_and_votes(spark):
    s = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "k long, correct int")
    v = ds.vote_label(s, ["k"]).withColumn("v", F.col("votes") / F.col("n_samples"))
    rows = sorted((r.label, r.weight) for r in ds.soft_rows(v, "v").collect())
    assert rows == [(0, 1 - 2 / 3), (1, 2 / 3)]


def test_pad_with_mask_left_and_right(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4])], "b long, t array<int>")
    right = sorted((r.input_ids, r.attention_mask) for r in ds.pad_with_mask(df, "t", "b").collect())
    left = sorted((r.input_ids, r.attention_mask) for r in ds.pad_with_mask(df, "t", "b", side="left").collect())
    assert right == [([1, 2, 3], [1, 1, 1]), ([4, 0, 0], [1, 0, 0])]
    assert left == [([0, 0, 4], [0, 0, 1]), ([1, 2, 3], [1, 1, 1])]


def test_mixture_probs_uniform_when_coeff_zero(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "d string")
    p = {r.d: r.prob for r in ds.mixture_probs(df, "d", 0.0).collect()}
    assert abs(p["a"] - 0.5) < 1e-12 and abs(p["b"] - 0.5) < 1e-12


def test_pick_contrast_eval_and_training_bounds(spark):
    ctx = "array<struct<title:string,text:string>>"
    rows = [(1, "q1", [("T", "gold a"), ("", "gold b")], [("N", "neg 1"), ("", "neg 2")], [("H", "h0"), ("H", "h1"), ("H", "h2")]),
            (2, "q2", [("", "only gold")], [], [("H", "h0")])]
    df = spark.createDataFrame(rows, f"qid long, question string, positive_ctxs {ctx}, negative_ctxs {ctx}, "
                                     f"hard_negative_ctxs {ctx}")
    ev = {r.qid: (r.gold, r.negatives) for r in ds.pick_contrast(df, "qid", 4, 0.5, training=False).collect()}
    assert ev[1] == ("T gold a", ["N neg 1"]) and ev[2] == ("only gold", [])
    tr = {r.qid: r for r in ds.pick_contrast(df, "qid", 4, 1.0, hard_min=1, training=True, seed=3).collect()}
    assert tr[1].n_hard == 2 and tr[1].n_rand == 2 and len(tr[1].negatives) == 4   # hard capped by pool past hard_min
    assert tr[2].n_hard == 0 and tr[2].n_rand == 0 and tr[2].negatives == []
    assert set(tr[1].negatives[2:]) == {"H h1", "H h2"}


def test_probe_on_soft_rows(spark):
    from kestrel.operators import models as md
    rows = [(i, [float(i % 2), 1.0 - (i % 2)], (i % 2) * 8 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, f array<double>, votes int").withColumn("v", F.col("votes") / 10.0)
    soft = ds.soft_rows(df, "v")
    model = md.fit_probe(soft, "f", "label", weight="weight", max_iter=50)
    p = md.probe_predict(model, df, "f").select("id", F.element_at("probs", 2).alias("p1")).collect()
    hi = [r.p1 for r in p if r.id % 2 == 1]
    lo = [r.p1 for r in p if r.id % 2 == 0]
    assert min(hi) > 0.8 and max(lo) < 0.2   # recovers the soft targets 0.9 / 0.1
