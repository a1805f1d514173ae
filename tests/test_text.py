"""Hand-computed edge cases for the text column functions (B group)."""

import unicodedata

from pyspark.sql import functions as F

from kestrel.functions import text as tx


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_normalize_text_maps_and_deletes(spark):
    s = "a—b “q” ‘s’ ″ x… . . . y⁄z­w\u0001\u0010\u000b"
    out = one(spark, tx.normalize_text("v"), s)
    assert out == "a-b \"q\" 's' '' x... ... y/zw\u0010 "


def test_normalize_text_keeps_tilde_and_plus(spark):
    assert one(spark, tx.normalize_text("v"), "～＋") == "～＋"


def test_word_tokens_classes(spark):
    toks = one(spark, tx.word_tokens("v"), "Héllo, WORLD! 12ab  x")
    assert toks == ["héllo", ",", "world", "!", "12ab", "x"]


def test_tokens_nfc_nfd_agree(spark):
    composed = "café au lait"
    decomposed = unicodedata.normalize("NFD", composed)
    a = one(spark, tx.word_tokens(tx.canonical_unicode("v")), decomposed)
    b = one(spark, tx.word_tokens("v"), composed)
    assert a == b


def test_normalize_answer(spark):
    assert one(spark, tx.normalize_answer("v"), "The  Cat, an apple; a-b!") == "cat apple ab"
    assert one(spark, tx.normalize_answer("v"), "the a an") == ""


def test_render_template_resubstitutes(spark):
    df = spark.createDataFrame([("Q<title>", "T")], "q string, t string")
    out = df.select(tx.render_template("<question>|<title>", [("<question>", F.col("q")), ("<title>", F.col("t"))])).first()[0]
    assert out == "QT|T"


def test_extract_between_and_split_once(spark):
    df = spark.createDataFrame([("x Context: a\n b Answer: c Context: d",), ("no marker",)], "v string")
    secs = [r[0] for r in df.select(tx.extract_between("v", "Context:", "Answer:")).collect()]
    assert secs == ["a\n b", None]
    head, rest = tx.split_once("v", "\n")
    rows = df.select(head, rest).collect()
    assert rows[0][0] == "x Context: a" and rows[0][1] == " b Answer: c Context: d"
    assert rows[1][0] is None and rows[1][1] is None


def test_parse_confidence_edge_strings(spark):
    rows = [("87.5 (0-100)", "ct"), ("7", "number"), ("7.5", "number"), ("Likely", "ling"),
            ("abc", "ct"), ("Nope", "ling"), ("0.3", "ct")]
    df = spark.createDataFrame(rows, "c string, t string")
    got = [r[0] for r in df.select(tx.parse_confidence("c", "t")).collect()]
    assert abs(got[0] - 0.875) < 1e-12
    assert abs(got[1] - (7 / 11 + 8 / 11) / 2) < 1e-12
    assert abs(got[2] - 0.75) < 1e-12
    assert abs(got[3] - 0.5) < 1e-12
    assert got[4] is None and got[5] is None
    assert abs(got[6] - 0.003) < 1e-12


def test_format_confidence(spark):
    df = spark.createDataFrame([(0.8765, "ct"), (7.0, "number"), (5.0, "ling")], "c double, t string")
    got = [r[0] for r in df.select(tx.format_confidence("c", "t")).collect()]
    assert got == ["87.65 (0-100)", "7.0 (0-10)", "Likely"]


def test_verbal_scale_roundtrip(spark):
    df = spark.range(11).select(F.col("id").cast("int").alias("i"))
    got = df.select(tx.verbal_index(tx.verbal_label("i")).alias("j")).collect()
    assert [r.j for r in got] == list(range(11))
    assert one(spark, tx.verbal_index("v"), "Unknown") is None


def test_parse_list_and_verdict(spark):
    assert one(spark, tx.parse_list("v"), "['a', 'b c']") == ["a", "b c"]
    assert one(spark, tx.parse_list("v"), '["x"]') == ["x"]
    assert one(spark, tx.parse_list("v"), "not a list") is None
    assert one(spark, tx.parse_verdict("v"), "  YES, it is ") == 1
    assert one(spark, tx.is_abstain("v"), "I have No Answer") is True


def test_judge_prompt_numbers_from_one(spark):
    df = spark.createDataFrame([(["p", "q"], "Q?", "G")], "p array<string>, q string, g string")
    out = df.select(tx.judge_prompt("<question>/<ground-truth>/<predictions>", "p", F.col("q"), F.col("g"))).first()[0]
    assert out == "Q?/G/1. p\n2. q"


def test_inject_before_every_marker(spark):
    out = one(spark, tx.inject_before("v", "Answer:", tx.temperature_line(F.lit(1.25))), "a Answer: b Answer:")
    assert out == "a Temperature: 1.2500\nAnswer: b Temperature: 1.2500\nAnswer:"
