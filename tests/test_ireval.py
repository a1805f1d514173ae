"""Answer matching and rank-list metrics: hand-computed edge cases."""

import unicodedata

from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.operators import ireval as ev


def test_has_answer_edges(spark):
    rows = [("The Eiffel Tower is in Paris.", ["eiffel tower"]),     # contiguous, uncased
            ("Tower Eiffel", ["eiffel tower"]),                       # order matters
            (None, ["x"]),                                            # null passage → false
            ("anything", ["..."]),                                    # punctuation tokens still tokens
            ("anything", [" "]),                                      # answer with no tokens → true
            (unicodedata.normalize("NFD", "un café noir"), ["café"]),  # decomposed vs composed
            ("ab cd", ["b c"])]                                       # no partial-token matches
    df = spark.createDataFrame(rows, "text string, answers array<string>")
    got = [r.hit for r in ev.has_answer(df, "text", "answers").collect()]
    assert got == [True, False, False, False, True, True, False]


def test_exact_match_and_f1(spark):
    df = spark.createDataFrame([("The cat sat", ["a cat sat", "dog"]), ("cat cat dog", ["cat dog dog"]),
                                ("x", ["y"])], "pred string, golds array<string>")
    rows = df.select(ev.exact_match("pred", "golds").alias("em"), ev.token_f1("pred", "golds").alias("f1")).collect()
    assert [r.em for r in rows] == [1, 0, 0]
    assert abs(rows[1].f1 - 2 / 3) < 1e-12 and rows[2].f1 == 0.0 and rows[0].f1 == 1.0


def test_rank_list_metrics(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5, 0.9],), ([1.0, 2.0, 3.0],)], "s array<double>")
    x = df.select(ar.rank_by_score("s").alias("x"))
    got = x.select("x", ar.inversions("x").alias("inv"), ar.gold_topk_overlap("x", 2).alias("ov"),
                   ar.depth_to_cover("x", 1).alias("d1"), ar.depth_to_cover(F.array(F.lit(5), F.lit(6)), 1).alias("none")
                   ).collect()
    assert got[0].x == [1, 3, 2, 0] and got[0].inv == 4 and got[0].ov == 0.5 and got[0].d1 == 4
    assert got[1].x == [2, 1, 0] and got[1].inv == 3 and got[1].d1 == 3
    assert got[0].none == 2  # no gold item below k: the whole list


def test_topk_hits_cumulative(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (2, 0, True), (3, 0, False), (3, 1, False)],
                               "qid long, rank int, hit boolean")
    assert [r.hits for r in ev.topk_hits(df).orderBy("k").collect()] == [1, 2]
