"""Rerank selection: relational forms against the recursive walk."""

import random


from kestrel.operators import rerank as rr


def walk(attempts, threshold, top_k):
    """The recursive semantics: visit ranks in order, a question leaves when
    prob >= threshold; then arg-max c over visited ranks, first wins ties."""
    out = {}
    by_q = {}
    for q, r, c, p in attempts:
        by_q.setdefault(q, []).append((r, c, p))
    for q, rows in by_q.items():
        visited = []
        for r, c, p in sorted(rows):
            if r >= top_k:
                break
            visited.append((r, c))
            if p >= threshold:
                break
        best = max(visited, key=lambda x: (x[1], -x[0]))
        out[q] = best[0]
    return out


def test_threshold_stop_equals_recursive_walk(spark):
    rng = random.Random(11)
    rows = [(q, r, round(rng.random(), 1), round(rng.random(), 1)) for q in range(400) for r in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "qid long, rank int, c double, prob double")
    for thr, k in [(0.8, 10), (1.0, 20), (0.0, 5)]:
        exp = walk(rows, thr, k)
        got = {r.qid: r.rank for r in rr.threshold_stop(df, thr, k).collect()}
        assert got == exp


def test_select_best_first_rank_wins_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0.1), (1, 1, 0.9, 0.1), (1, 2, 0.9, 0.8)], "qid long, rank int, c double, prob double")
    assert rr.select_best(df).first()["rank"] == 1
    assert rr.select_best_class_prob(df).first()["rank"] == 2
    assert rr.multi_first_only(df).first()["rank"] == 0


def test_merge_best_k(spark):
    tpl = "Q: <question>\nContext: <title> - <context>\nAnswer:"
    rows = [(1, r, "q?", f"Q: q?\nContext: T{r} - text{r}\nAnswer:", c) for r, c in [(0, 0.2), (1, 0.9), (2, 0.9), (3, 0.5)]]
    df = spark.createDataFrame(rows, "qid long, rank int, q string, z_prompt string, c double")
    m = rr.merge_best_k(df, 2, tpl, "Context:", "Answer:").first()
    assert m["context_block"] == "\nT1 - text1\nT2 - text2"
    assert m["z_prompt"] == "Q: q?\nContext: \nT1 - text1\nT2 - text2\nAnswer:"


def test_ensemble_class_prob(spark):
    df = spark.createDataFrame([(1, 0, [0.1, 0.7, 0.7]), (1, 0, [0.5, 0.2, 0.3])], "qid long, rank int, probs array<double>")
    r = rr.ensemble_class_prob(df).first()
    assert r["c"] == 0.5 and abs(r["prob"] - 0.6) < 1e-12


def test_explode_attempts_uses_each_rows_depth(spark):
    ctx = "array<struct<id:long,title:string,text:string,score:double>>"
    df = spark.createDataFrame([(1, "q", [(5, "a", "x", 1.0)]), (2, "r", [(6, "b", "y", 1.0), (7, "c", None, 0.5)])],
                               f"qid long, q string, contexts {ctx}")
    out = rr.explode_attempts(df, "<question>|<title>|<context>").orderBy("qid", "rank").collect()
    assert [(r.qid, r.rank, r.z_prompt) for r in out] == [(1, 0, "q|a|x"), (2, 0, "r|b|y")]  # null text dropped


def test_wave_mode_equals_relational(spark):
    rng = random.Random(2)
    rows = [(q, r, round(rng.random(), 1), round(rng.random(), 1)) for q in range(60) for r in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "qid long, rank int, c double, prob double")
    cands = df.select("qid", "rank")
    waves = rr.threshold_stop_waves(cands, lambda w: w.join(df, ["qid", "rank"]), threshold=0.7, top_k=6)
    got = {r.qid: r.rank for r in waves.collect()}
    assert got == walk(rows, 0.7, 6)
