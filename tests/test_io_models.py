"""Sources/sinks round trips, fitted models and the scoring stage."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import models as md
from kestrel.operators import scoring as scr
from kestrel.sources import io
from tests.conftest import SF001


def test_read_passages_tsv_quotes_newlines_and_header(spark, tmp_path):
    p = tmp_path / "psgs.tsv"
    p.write_text('id\ttext\ttitle\n1\t"say ""hi""\nthere"\tT1\n2\tplain\t\nid\tx\ty\n', encoding="utf-8")
    rows = sorted((r.pid, r.text, r.title) for r in io.read_passages(spark, str(p)).collect())
    assert rows == [(1, 'say "hi"\nthere', "T1"), (2, "plain", "")]


@pytest.mark.parametrize("parts,aqe", [(1, True), (8, True), (8, False), (211, True), (211, False)])
def test_array_files_come_back_whole(spark, tmp_path, parts, aqe):
    """Every object comes back, whatever the partitions, with and without
    adaptive execution, with a shuffle just before the sink."""
    rows = spark.range(400).select(F.col("id").cast("string").alias("q"), F.concat(F.lit('[a],\n]"'), "id").alias("y"), F.lit(None).cast("string").alias("x"),
                                   F.array(F.struct(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("x\ny").alias("text"),
                                                    (F.col("id") / 7).alias("score"))).alias("contexts"))
    path = str(tmp_path / "a.json")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", str(aqe).lower())
    try:
        io.write_retrieval_array(rows.repartition(parts, "q") if parts != 8 else rows.repartition("q"), path)
        want = sorted((r.q, r.y, r.x, r.contexts) for r in rows.collect())
        for lines in (False, True):
            back = io.read_retrieval_array(spark, path, lines=lines)
            assert sorted((r.q, r.y, r.x, r.contexts) for r in back.collect()) == want
            assert sorted(r.row_id for r in back.collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    import glob
    import json

    assert sum(len(json.load(open(f))) for f in glob.glob(path + "/part-*") if open(f).read(1)) == 400


def test_array_files_with_more_than_one_array_are_refused(spark, tmp_path):
    (tmp_path / "two.json").write_text('[\n {"q": "a"}\n]\n[\n {"q": "b"}\n]\n')
    with pytest.raises(ValueError, match="more than one"):
        io.read_retrieval_array(spark, str(tmp_path / "two.json"))
    (tmp_path / "one.json").write_text('[{"q": "a", "contexts": [{"id": 3, "score": "0.5"}]},\n {"q": "b"}]')
    rows = io.read_retrieval_array(spark, str(tmp_path / "one.json")).orderBy("row_id").collect()
    assert [r.q for r in rows] == ["a", "b"] and rows[0].contexts[0].score == 0.5
    empty = spark.createDataFrame([], "q string, y string, x string")
    io.write_retrieval_array(empty, str(tmp_path / "none.json"))
    assert io.read_retrieval_array(spark, str(tmp_path / "none.json")).count() == 0


def test_maxload_counts_over_files(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("qid"), F.lit("q").alias("question"))
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.json")
    rows.where("qid < 10").coalesce(1).write.json(a)
    io.write_retrieval_array(rows.where("qid >= 10").coalesce(1), b)
    for cap in (4, 10, 17):
        assert sorted(r.qid for r in io.read_train_examples(spark, [a, b], maxload=cap).collect()) == list(range(cap))
    assert io.read_train_examples(spark, [a, b]).count() == 30


def test_dataset_key_rule(spark):
    df = spark.createDataFrame([("oe_nq.csv",), ("base_tqa_x.csv",)], "f string")
    assert [r[0] for r in df.select(io.dataset_key("f")).collect()] == ["nq", "tqa"]


def test_load_vectors_checks_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1]), (1, [0.2])], "vec_id long, embedding array<double>")
    path = str(tmp_path / "v")
    io.save_vectors(df, path)
    try:
        io.load_vectors(spark, path)
        raise AssertionError("duplicate ids must fail")
    except ValueError:
        pass


def test_skip_if_done(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(2,)], "k long")
    assert sorted(r.k for r in io.skip_if_done(a, b, ["k"]).collect()) == [1, 3]


def test_probe_beats_majority(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    model = md.fit_probe(e, "embedding", "label", max_iter=50)
    p = md.probe_predict(model, e, "embedding")
    acc = p.select(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    majority = e.groupBy("label").count().agg(F.max("count")).first()[0] / e.count()
    assert acc > majority


def test_temperature_scaling_lowers_nll(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    lg = e.select(F.transform(F.slice("embedding", 1, 10), lambda v: v * 30.0).alias("l"), "label")
    r = md.fit_temperature(lg, "l", "label")
    assert r["nll_after"] <= r["nll_before"] + 1e-12 and r["temperature"] > 0


def test_score_stage_dedupes_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i long, p string")
    calls = []

    def scorer(s):
        calls.append(len(s))
        return scr.hash_scorer(s)

    cache = str(tmp_path / "cache")
    out = {r.i: r.score for r in scr.score_stage(df, "p", scorer, cache_path=cache).collect()}
    assert out[1] == out[2] and len(out) == 3
    again = {r.i: r.score for r in scr.score_stage(df, "p", scr.hash_scorer, cache_path=cache).collect()}
    assert again == out
    assert spark.read.parquet(cache).count() == 2  # nothing re-scored on the second run


def test_probe_with_temperature_features(spark):
    df = spark.createDataFrame([(i, [float(i % 3)], i % 2, 1.0 + (i % 6) / 10.0) for i in range(60)],
                               "id long, f array<double>, y int, t double")
    model = md.fit_probe(df, "f", "y", temperature="t", max_iter=20)
    assert model.numFeatures == 1 + 12
    out = md.probe_predict(model, df, "f", temperature="t")
    assert out.count() == 60 and len(out.first()["probs"]) == 2


def test_read_qa_dir_file_names_positions_and_dropna(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "oe_nq.csv").write_text('id,x,y\n1,"q one","a"\n3,,c\n2,"q\ntwo",b\n', encoding="utf-8")
    (d / "oe_tqa.csv").write_text("id,x,y\n7,q7,a7\n", encoding="utf-8")
    df = io.read_qa_dir(spark, str(d), "id long, x string, y string")
    got = sorted((r.dataset, r.row_id, r.id, r.x) for r in df.collect())
    # the row with a null x is dropped before positions are taken
    assert got == [("nq", 0, 1, "q one"), ("nq", 1, 2, "q\ntwo"), ("tqa", 0, 7, "q7")]
