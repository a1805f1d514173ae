"""Fitted-model (I) and scoring-stage (J) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import calibration as cal
from kestrel.operators import calls
from kestrel.operators import models as md
from kestrel.operators import scoring as scr
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.operators import rerank as rr
from kestrel.plans.oracle import sql
from kestrel.plans.q_rerank import END, START, TEMPLATE, attempts_mean, prompts
from kestrel.sources.io import scratch_path


@query("i1_fit_probe", None)
def i1(spark, d):
    e = fx.table(spark, d, "embeddings")
    w = cal.class_weights(e, "label", 10)
    x = e.join(F.broadcast(w), e.label == w.cls).drop("cls")
    model = md.fit_probe(x, "embedding", "label", weight="weight", max_iter=50)
    p = md.probe_predict(model, e.select("vec_id", "embedding", "label"), "embedding")
    return p.select("vec_id", "label", "pred", r6(F.array_max("probs")).alias("conf"))


@query("i1b_weighted_probe", None)
def i1b(spark, d):
    """Hidden layers, class weights; quasi-Newton over all rows (a fixed number
    of steps; tests/ compares weights with repeated rows)."""
    e = fx.table(spark, d, "embeddings")
    w = cal.class_weights(e, "label", 10)
    x = e.join(F.broadcast(w), e.label == w.cls).drop("cls")
    model = md.fit_probe(x, "embedding", "label", weight="weight", hidden=[32, 16], max_iter=20)
    p = md.probe_predict(model, e.select("vec_id", "embedding", "label"), "embedding")
    return p.select("vec_id", "label", "pred", r6(F.array_max("probs")).alias("conf"))


# the mean NLL is convex in a = 1/T: a bisection on its slope in SQL
@query("i2_fit_temperature", sql("""SELECT * FROM (WITH RECURSIVE z AS (SELECT list_transform(logits, lambda v: v * 20.0) AS z, y FROM fx_logits),
slope AS (SELECT 1 AS step, 1e-3 AS lo, 1e3 AS hi UNION ALL
  SELECT step + 1, CASE WHEN g < 0 THEN sqrt(lo * hi) ELSE lo END, CASE WHEN g < 0 THEN hi ELSE sqrt(lo * hi) END FROM (
    SELECT step, lo, hi, (SELECT avg(list_sum(list_transform(z, lambda v: v * exp(sqrt(s.lo * s.hi) * (v - list_max(z)))))
      / list_sum(list_transform(z, lambda v: exp(sqrt(s.lo * s.hi) * (v - list_max(z))))) - z[y + 1]) FROM z) AS g FROM slope s WHERE step < 60)),
best AS (SELECT sqrt(lo * hi) AS a FROM slope ORDER BY step DESC LIMIT 1),
nll AS (SELECT avg(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[y + 1]) AS before,
  avg(ln(list_sum(list_transform(z, lambda v: exp(a * (v - list_max(z)))))) + a * (list_max(z) - z[y + 1])) AS after FROM z, best)
SELECT round(1 / a, 4) AS temperature, round(before, 6) AS nll_before, round(after, 6) AS nll_after FROM best, nll)""", "fx_logits"))
def i2(spark, d):
    lg = fx.logits(spark, d).withColumn("logits", F.transform("logits", lambda v: v * 20.0))
    r = md.fit_temperature(lg, "logits", "y", tol=1e-10)
    one = spark.range(1)
    return one.select(F.round(F.lit(r["temperature"]), 4).alias("temperature"), r6(F.lit(r["nll_before"])).alias("nll_before"),
                      r6(F.lit(r["nll_after"])).alias("nll_after"))


@query("j1_score_stage", sql("""SELECT qid, rank, round(('0x' || substr(md5(z_prompt), 1, 8))::BIGINT / 4294967296.0, 6) AS score
  FROM fx_prompts""", "fx_prompts"))
def j1(spark, d):
    p = prompts(spark, d).select("qid", "rank", "z_prompt")
    cache = scratch_path(spark, "scores")  # holds half of the scores, twice, before the call
    half = p.where(F.col("qid") % 2 == 0).select(F.md5("z_prompt").alias("pkey"), fx.uniform_of("z_prompt").alias("score"))
    half.unionByName(half).write.parquet(cache)
    s = scr.score_stage(p, "z_prompt", scr.hash_scorer, cache_path=cache)
    return s.select("qid", "rank", r6("score").alias("score"))


def flaky(prompt: str, attempt: int) -> float:
    """Stand-in for a remote call: fails by a rule of prompt and attempt, else
    the prompt's hash as a number."""
    import hashlib

    def first(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0

    if first(f"{prompt}-{attempt}") < 0.5:
        raise TimeoutError(f"attempt {attempt}")
    return first(prompt)


@query("j1b_call_stage", sql("""SELECT qid, rank, round(CASE WHEN good IS NOT NULL THEN ('0x' || substr(md5(z_prompt), 1, 8))::BIGINT / 4294967296.0 END, 6) AS score,
  CASE WHEN good IS NULL THEN 'TimeoutError: attempt 3' END AS error, CAST(coalesce(good, 3) AS INTEGER) AS calls
FROM (SELECT *, list_min(list_filter([1, 2, 3], lambda a: ('0x' || substr(md5(z_prompt || '-' || a), 1, 8))::BIGINT / 4294967296.0 >= 0.5)) AS good
  FROM fx_prompts)""", "fx_prompts"))
def j1b(spark, d):
    """Calls that fail half of the time, three attempts, waves of 500."""
    p = prompts(spark, d).select("qid", "rank", "z_prompt")
    s = calls.call_stage(p, "z_prompt", flaky, scratch_path(spark, "calls"), out="score", attempts=3, wait=0.001, wave_rows=500)
    return s.select("qid", "rank", r6("score").alias("score"), F.col("score_error").alias("error"), F.col("score_calls").alias("calls"))


_AT = ", ".join(str(1 + t / 10) for t in range(6))


@query("e10_merge_rescore", sql(f"""SELECT qid, md5(z) AS z_md5, round(avg(('0x' || substr(md5(
    replace(z, '{END}', printf('Temperature: %.4f', t) || chr(10) || '{END}')), 1, 8))::BIGINT / 4294967296.0), 6) AS c
FROM (SELECT qid, replace(replace('{TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '<question>', q), '<title> - <context>', block) AS z
  FROM (SELECT qid, first(q ORDER BY pos) AS q, chr(10) || string_agg(sec, chr(10) ORDER BY pos) AS block FROM e6_top WHERE pos < 3 GROUP BY qid)),
  (SELECT unnest([{_AT}])::DOUBLE AS t) GROUP BY qid, z""", "e6_top"))
def e10(spark, d):
    """Best three attempts merged, scored again at six temperatures, mean."""
    a = prompts(spark, d).join(attempts_mean(spark, d), ["qid", "rank"]).join(fx.queries(spark, d).select("qid", "q"), "qid")
    score = lambda df: scr.score_stage(df, "prompt", scr.hash_scorer, out="c")
    m = rr.merge_and_rescore(a, 3, TEMPLATE, START, END, [1 + t / 10 for t in range(6)], score)
    return m.select("qid", F.md5("z_prompt").alias("z_md5"), r6("c").alias("c"))
