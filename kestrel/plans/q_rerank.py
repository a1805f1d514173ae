"""Rerank (E) and retrieval/reader evaluation (D) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.functions import text as tx
from kestrel.functions.hashing import hash_int, uniform
from kestrel.operators import ireval as ev
from kestrel.operators import rerank as rr
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.session import materialize
from kestrel.plans.oracle import register, sql, toks, u

# Prompt wording is a user parameter; this one is ours.
TEMPLATE = "Question: <question>\nContext: <title> - <context>\nAnswer:"
START, END = "Context:", "Answer:"


def tpl_sql(q, title, text, tpl=TEMPLATE):
    t = tpl.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"replace(replace(replace('{t}', '<question>', {q}), '<title>', {title}), '<context>', {text})"


# ---------------------------------------------------------------------------
# attempt tables
# ---------------------------------------------------------------------------

def attempts_mean(spark, d):
    """Temperature-averaged attempts (c, prob) rounded to 9 digits."""
    a = fx.attempts(spark, d)
    return a.groupBy("qid", "rank").agg(F.round(F.avg("c"), 9).alias("c"), F.round(F.avg("prob"), 9).alias("prob"))


register("fx_amean", ["fx_attempts"], """SELECT qid, rank, round(avg(c), 9) AS c, round(avg(prob), 9) AS prob
  FROM fx_attempts GROUP BY qid, rank""")


def attempt_probs(spark, d):
    a = fx.attempts(spark, d).select("qid", "rank", "pid", "t")
    probs = F.transform(F.sequence(F.lit(0), F.lit(10)),
                        lambda i: F.round(uniform("pr", F.col("qid"), F.col("pid"), F.col("t"), i), 2))
    return a.select("qid", "rank", "t", probs.alias("probs"))


register("fx_aprobs", ["fx_attempts"], f"""SELECT qid, rank, t,
  list_transform(range(11), lambda i: round({u('pr', 'qid', 'pid', 't', 'i')}, 2)) AS probs FROM fx_attempts""")
register("fx_acls", ["fx_aprobs"], """SELECT qid, rank, round(avg(list_position(probs, list_max(probs)) - 1), 9) AS c,
  round(avg(list_max(probs)), 9) AS prob FROM fx_aprobs GROUP BY qid, rank""")


def class_prob(spark, d):
    x = rr.ensemble_class_prob(attempt_probs(spark, d))
    return x.select("qid", "rank", F.round("c", 9).alias("c"), F.round("prob", 9).alias("prob"))


register("fx_prompts", ["fx_ctx", "fx_queries"], f"""SELECT c.qid, c.rank, c.pid, q.q, c.title AS d_t, c.text AS d,
  {tpl_sql('q.q', 'c.title', 'c.text')} AS z_prompt FROM fx_ctx c JOIN fx_queries q USING (qid)""")


def prompts(spark, d):
    return rr.explode_attempts(fx.retrievals(spark, d), TEMPLATE)


# ---------------------------------------------------------------------------
# E1 – E9
# ---------------------------------------------------------------------------

@query("e1_explode_attempts", sql(
    "SELECT qid, rank, pid, d_t, md5(z_prompt) AS z_md5, CAST(length(z_prompt) AS INTEGER) AS z_len FROM fx_prompts", "fx_prompts"))
def e1(spark, d):
    p = prompts(spark, d)
    return p.select("qid", "rank", "pid", "d_t", F.md5("z_prompt").alias("z_md5"), F.length("z_prompt").alias("z_len"))


@query("e2_top1_context", sql("SELECT qid, pid, title AS d_t, md5(text) AS d_md5 FROM fx_ctx WHERE rank = 0", "fx_ctx"))
def e2(spark, d):
    t = rr.top1_context(fx.retrievals(spark, d))
    return t.select("qid", "pid", "d_t", F.md5("d").alias("d_md5"))


BEST_SQL = """SELECT qid, rank, round(c, 6) AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, rank ASC) AS rn FROM {src}) WHERE rn = 1"""


@query("e3_select_best", sql(BEST_SQL.format(src="fx_amean"), "fx_amean"))
def e3(spark, d):
    b = rr.select_best(attempts_mean(spark, d))
    return b.select("qid", "rank", r6("c").alias("c"))


@query("e4_threshold_stop", sql(BEST_SQL.format(src="""(SELECT a.* FROM fx_amean a
  LEFT JOIN (SELECT qid, min(rank) AS stop FROM fx_amean WHERE prob >= 0.6 AND rank < 20 GROUP BY qid) s USING (qid)
  WHERE a.rank < 20 AND (s.stop IS NULL OR a.rank <= s.stop))"""), "fx_amean"))
def e4(spark, d):
    b = rr.threshold_stop(attempts_mean(spark, d), threshold=0.6, top_k=20)
    return b.select("qid", "rank", r6("c").alias("c"))


@query("e5_select_best_class_prob", sql("""SELECT qid, rank, round(c, 6) AS c, round(prob, 6) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, prob DESC, rank ASC) AS rn FROM fx_acls) WHERE rn = 1""",
                                         "fx_acls"))
def e5(spark, d):
    b = rr.select_best_class_prob(class_prob(spark, d))
    return b.select("qid", "rank", r6("c").alias("c"), r6("prob").alias("prob"))


register("e6_top", ["fx_prompts", "fx_amean"], f"""SELECT p.qid, p.q, a.c, p.rank,
  row_number() OVER (PARTITION BY p.qid ORDER BY a.c DESC, p.rank ASC) - 1 AS pos,
  regexp_replace(split_part(split_part(p.z_prompt, '{START}', 2), '{END}', 1), '^\\s+|\\s+$', '', 'g') AS sec
  FROM fx_prompts p JOIN fx_amean a USING (qid, rank)""")


@query("e6_merge_best_k", sql(f"""SELECT qid, md5(block) AS block_md5,
  md5(replace(replace('{TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '<question>', q), '<title> - <context>', block)) AS z_md5
FROM (SELECT qid, first(q ORDER BY pos) AS q, chr(10) || string_agg(sec, chr(10) ORDER BY pos) AS block
      FROM e6_top WHERE pos < 3 GROUP BY qid)""", "e6_top"))
def e6(spark, d):
    a = prompts(spark, d).join(attempts_mean(spark, d), ["qid", "rank"]).join(
        fx.queries(spark, d).select("qid", "q"), "qid")
    m = rr.merge_best_k(a, 3, TEMPLATE, START, END)
    return m.select("qid", F.md5("context_block").alias("block_md5"), F.md5("z_prompt").alias("z_md5"))


@query("e7_ensemble_mean", sql("SELECT qid, rank, round(c, 6) AS c FROM fx_amean", "fx_amean"))
def e7(spark, d):
    m = rr.ensemble_mean(fx.attempts(spark, d))
    return m.select("qid", "rank", r6("c").alias("c"))


@query("e8_ensemble_class_prob", sql("SELECT qid, rank, round(c, 6) AS c, round(prob, 6) AS prob FROM fx_acls", "fx_acls"))
def e8(spark, d):
    return class_prob(spark, d).select("qid", "rank", r6("c").alias("c"), r6("prob").alias("prob"))


@query("e9_multi_first_only", sql("SELECT qid, rank, round(c, 6) AS c FROM fx_amean WHERE rank = 0", "fx_amean"))
def e9(spark, d):
    b = rr.multi_first_only(attempts_mean(spark, d))
    return b.select("qid", "rank", r6("c").alias("c"))


# ---------------------------------------------------------------------------
# D1 – D11
# ---------------------------------------------------------------------------

def hits(spark, d, run=None):
    """Answer hit for every retrieved (question, passage) pair: the run joins
    passage text and the question's answers directly (run and queries are
    small next to the corpus; Spark broadcasts them)."""
    run = (fx.run(spark, d) if run is None else run).select("qid", "rank", "pid")
    docs = fx.corpus(spark, d).select("pid", "text")
    q = fx.queries(spark, d).select("qid", F.array("answer").alias("answers"))
    ex = run.join(docs, "pid").join(q, "qid")
    return ev.has_answer(ex, "text", "answers").select("qid", "rank", "pid", "hit")


def jt_sql(expr):
    return f"(' ' || array_to_string({toks('nfc_normalize(' + expr + ')')}, ' ') || ' ')"


register("fx_hits", ["fx_ctx", "fx_queries"], f"""SELECT c.qid, c.rank, c.pid,
  CASE WHEN c.text IS NULL THEN false
       ELSE (len({toks('q.answer')}) = 0 OR contains({jt_sql('c.text')}, {jt_sql('q.answer')})) END AS hit
  FROM fx_ctx c JOIN fx_queries q USING (qid)""")
# qrels: hits are relevant; a non-hit at rank 0 is judged non-relevant
register("fx_qrels", ["fx_hits"], """SELECT qid, pid, CASE WHEN hit THEN 1 ELSE 0 END AS rel FROM fx_hits
  WHERE hit OR rank = 0""")


def qrels(spark, d, run=None):
    """Hits are relevant, a non-hit at rank 0 is judged non-relevant. Written
    once: the metrics read qrels in several branches."""
    h = hits(spark, d, run)
    return materialize(h.where(F.col("hit") | (F.col("rank") == 0)).select(
        "qid", "pid", F.when(F.col("hit"), 1).otherwise(0).alias("rel")))


@query("d1_has_answer", sql("SELECT qid, rank, pid, CAST(hit AS INTEGER) AS hit FROM fx_hits", "fx_hits"))
def d1(spark, d):
    return hits(spark, d).select("qid", "rank", "pid", F.col("hit").cast("int").alias("hit"))


@query("d2_topk_hits", sql("""SELECT CAST(k AS INTEGER) AS k, CAST(coalesce(sum(n) FILTER (WHERE best <= k), 0) AS BIGINT) AS hits
FROM range(40) r(k), (SELECT best, count(*) AS n FROM (SELECT qid, min(rank) AS best FROM fx_hits WHERE hit GROUP BY qid) GROUP BY best)
GROUP BY k""", "fx_hits"))
def d2(spark, d):
    return ev.topk_hits(hits(spark, d), depth=40)


KS = [1, 3, 5, 10]

register("ir_rank", ["fx_run", "fx_qrels"], """SELECT r.qid, r.pid, CAST(r.rank + 1 AS BIGINT) AS rank,
  coalesce(q.rel, 0) AS gain, CAST(coalesce(q.rel, 0) > 0 AS INTEGER) AS hit,
  CASE WHEN r.pid IN (SELECT pid FROM fx_qrels) THEN 0 ELSE 1 END AS hole
  FROM fx_run r LEFT JOIN fx_qrels q USING (qid, pid) WHERE r.qid IN (SELECT qid FROM fx_qrels)""")
register("ir_cum", ["ir_rank"], """SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM ir_rank""")
register("ir_ideal", ["fx_qrels"], """SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, pid ASC) AS i
  FROM fx_qrels WHERE rel > 0""")
register("ir_nrel", ["fx_qrels"], "SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS n_rel FROM fx_qrels GROUP BY qid")
register("ir_q", ["ir_rank"], f"SELECT DISTINCT qid, unnest({KS}) AS k FROM ir_rank")
register("ir_per", ["ir_q", "ir_cum", "ir_ideal", "ir_nrel"], """SELECT q.qid, q.k,
  (SELECT sum(gain / log2(rank + 1)) FROM ir_cum c WHERE c.qid = q.qid AND c.rank <= q.k) AS dcg,
  (SELECT sum(rel / log2(i + 1)) FROM ir_ideal i WHERE i.qid = q.qid AND i.i <= q.k) AS idcg,
  (SELECT sum(CASE WHEN hit = 1 THEN cum_hits / rank ELSE 0 END) FROM ir_cum c WHERE c.qid = q.qid AND c.rank <= q.k) AS ap_sum,
  (SELECT coalesce(sum(hit), 0) FROM ir_cum c WHERE c.qid = q.qid AND c.rank <= q.k) AS hits,
  (SELECT min(rank) FROM ir_cum c WHERE c.qid = q.qid AND c.rank <= q.k AND hit = 1) AS first_hit,
  (SELECT coalesce(sum(hole), 0) FROM ir_cum c WHERE c.qid = q.qid AND c.rank <= q.k) AS holes,
  coalesce(n.n_rel, 0) AS n_rel, 'ds' || CAST(""" + "(('0x' || substr(md5('ds' || '-' || CAST(q.qid AS VARCHAR)), 1, 8))::BIGINT % 3)" + """ AS VARCHAR) AS dataset
  FROM ir_q q LEFT JOIN ir_nrel n USING (qid)""")
register("ir_m", ["ir_per"], """SELECT dataset, qid, k,
  CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg,
  CASE WHEN n_rel > 0 THEN coalesce(ap_sum, 0) / n_rel ELSE 0 END AS map,
  CASE WHEN n_rel > 0 THEN hits / n_rel ELSE 0 END AS recall,
  hits / k AS precision, coalesce(1.0 / first_hit, 0) AS mrr,
  CASE WHEN n_rel > 0 THEN hits / least(k, n_rel) ELSE 0 END AS recall_cap, holes / k AS hole FROM ir_per""")


def _ir(spark, d, group=None):
    run = fx.run(spark, d)  # a written table: the metrics and the judgments start from one retrieval
    r, q = run.select("qid", "pid", "score"), qrels(spark, d, run)
    if group:
        ds = F.concat(F.lit("ds"), (hash_int("ds", F.col("qid")) % 3).cast("string"))
        r = r.withColumn("dataset", ds)
    return ev.ir_metrics(r, q, KS, group=group)


@query("d3_ir_metrics", sql("""SELECT CAST(k AS INTEGER) AS k, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
  round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM ir_m GROUP BY k""", "ir_m"))
def d3(spark, d):
    m = _ir(spark, d)
    return m.select("k", *[r6(c).alias(c) for c in ["ndcg", "map", "recall", "precision"]])


@query("d4_ir_custom_metrics", sql("""SELECT CAST(k AS INTEGER) AS k, round(avg(mrr), 6) AS mrr,
  round(avg(recall_cap), 6) AS recall_cap, round(avg(hole), 6) AS hole FROM ir_m GROUP BY k""", "ir_m"))
def d4(spark, d):
    m = _ir(spark, d)
    return m.select("k", *[r6(c).alias(c) for c in ["mrr", "recall_cap", "hole"]])


@query("d5_macro_average", sql("""SELECT CAST(k AS INTEGER) AS k, round(avg(ndcg) * 100, 6) AS ndcg, round(avg(recall) * 100, 6) AS recall
FROM (SELECT dataset, k, avg(ndcg) AS ndcg, avg(recall) AS recall FROM ir_m GROUP BY dataset, k) GROUP BY k""", "ir_m"))
def d5(spark, d):
    m = _ir(spark, d, group=["dataset"])
    mac = ev.macro_average(m.select("dataset", "k", "ndcg", "recall"))
    return mac.select("k", r6("ndcg").alias("ndcg"), r6("recall").alias("recall"))


def preds_golds(spark, d):
    """The whole top passage as prediction; golds: the question's answer and
    the whole text that the question was taken from."""
    r = fx.retrievals(spark, d)
    return r.select("qid", F.element_at("contexts", 1)["text"].alias("pred"), F.array("answer", "q").alias("golds"))


register("fx_pg", ["fx_ctx", "fx_queries"], """SELECT c.qid, c.text AS pred, [q.answer, q.q] AS golds
  FROM fx_ctx c JOIN fx_queries q USING (qid) WHERE c.rank = 0""")

PUNCT_SQL = "'" + __import__("string").punctuation.replace("'", "''") + "'"


def norm_ans_sql(x):
    return (f"array_to_string(list_filter(string_split_regex(translate(lower({x}), {PUNCT_SQL}, ''), '\\s+'), "
            f"lambda w: w NOT IN ('a', 'an', 'the') AND w <> ''), ' ')")


def ans_toks_sql(x):
    return (f"list_filter(string_split_regex(translate(lower({x}), {PUNCT_SQL}, ''), '\\s+'), "
            f"lambda w: w NOT IN ('a', 'an', 'the') AND w <> '')")


@query("d6_exact_match", sql(f"""SELECT qid, CAST(len(list_filter(golds, lambda g: {norm_ans_sql('g')} = {norm_ans_sql('pred')})) > 0 AS INTEGER) AS em
FROM fx_pg""", "fx_pg"))
def d6(spark, d):
    return preds_golds(spark, d).select("qid", ev.exact_match("pred", "golds").alias("em"))


register("f1_gold", ["fx_pg"], "SELECT qid, unnest(range(1, len(golds) + 1)) AS g, unnest(golds) AS gold, pred FROM fx_pg")
register("f1_side", ["f1_gold"], f"""SELECT qid, g, 'p' AS side, {ans_toks_sql('pred')} AS toks FROM f1_gold
  UNION ALL SELECT qid, g, 'g', {ans_toks_sql('gold')} FROM f1_gold""")
register("f1_count", ["f1_side"], """SELECT qid, g, t, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'g') AS ng
  FROM (SELECT qid, g, side, unnest(toks) AS t FROM f1_side) GROUP BY qid, g, t""")


@query("d7_token_f1", sql("""SELECT qid, round(max(CASE WHEN common = 0 THEN 0.0 ELSE 2 * (common / p) * (common / g) / ((common / p) + (common / g)) END), 6) AS f1
FROM (SELECT qid, coalesce(sum(least(np, ng)), 0) AS common, sum(np) AS p, sum(ng) AS g
  FROM (SELECT DISTINCT qid, g FROM f1_gold) LEFT JOIN f1_count USING (qid, g) GROUP BY qid, g) GROUP BY qid""", "f1_gold", "f1_count"))
def d7(spark, d):
    return preds_golds(spark, d).select("qid", r6(ev.token_f1("pred", "golds")).alias("f1"))


# D8–D11 over the run: gold order = pid ascending, predicted scores = BM25 (rounded)
def score_lists(spark, d):
    r = fx.run(spark, d)
    g = r.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pid", F.round("score", 6).alias("s")))).alias("_l"))
    return g.select("qid", F.transform("_l", lambda z: z["s"]).alias("scores"))


register("fx_pos", ["fx_run"], """SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pid) - 1 AS INTEGER) AS pos,
  round(score, 6) AS s FROM fx_run""")
register("fx_x", ["fx_pos"], """SELECT qid, pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos ASC) AS INTEGER) AS i
  FROM fx_pos""")


@query("d11_rank_by_score", sql("SELECT qid, array_to_string(list(pos ORDER BY i), ',') AS x FROM fx_x GROUP BY qid", "fx_x"))
def d11(spark, d):
    s = score_lists(spark, d)
    return s.select("qid", F.array_join(ar.rank_by_score("scores"), ",").alias("x"))


@query("d8_inversions", sql("""SELECT a.qid, CAST(count(*) FILTER (WHERE b.i > a.i AND a.pos > b.pos) AS INTEGER) AS inversions
FROM fx_x a JOIN fx_x b USING (qid) GROUP BY a.qid""", "fx_x"))
def d8(spark, d):
    s = score_lists(spark, d).select("qid", ar.rank_by_score("scores").alias("x"))
    return s.select("qid", ar.inversions("x").alias("inversions"))


@query("d9_gold_topk_overlap", sql("""SELECT qid, round(count(*) FILTER (WHERE i <= 5 AND pos < 5) / least(5, count(*)), 6) AS overlap
FROM fx_x GROUP BY qid""", "fx_x"))
def d9(spark, d):
    s = score_lists(spark, d).select("qid", ar.rank_by_score("scores").alias("x"))
    return s.select("qid", r6(ar.gold_topk_overlap("x", 5)).alias("overlap"))


@query("d10_depth_to_cover", sql("""SELECT qid, CAST(coalesce(max(i) FILTER (WHERE pos < 5), count(*)) AS INTEGER) AS depth
FROM fx_x GROUP BY qid""", "fx_x"))
def d10(spark, d):
    s = score_lists(spark, d).select("qid", ar.rank_by_score("scores").alias("x"))
    return s.select("qid", ar.depth_to_cover("x", 5).cast("int").alias("depth"))


# attempts with missing ranks and with null probs
register("fx_gaps", ["fx_amean"], """SELECT qid, rank, c, CASE WHEN (qid + rank) % 7 <> 0 THEN prob END AS prob FROM fx_amean
  WHERE (qid + rank) % 5 <> 0""")


@query("e4b_threshold_stop_waves", sql(BEST_SQL.format(src="""(SELECT a.* FROM fx_gaps a
  LEFT JOIN (SELECT qid, min(rank) AS stop FROM fx_gaps WHERE prob >= 0.6 AND rank < 20 GROUP BY qid) s USING (qid)
  WHERE a.rank < 20 AND (s.stop IS NULL OR a.rank <= s.stop))"""), "fx_gaps"))
def e4b(spark, d):
    """Wave mode: only open questions are scored at each rank; the scorer
    here looks up the temperature-ensembled confidences."""
    at = F.col("qid") + F.col("rank")
    scores = attempts_mean(spark, d).withColumn("prob", F.when(at % 7 != 0, F.col("prob")))
    cands = fx.run(spark, d).select("qid", "rank").where(at % 5 != 0)
    b = rr.threshold_stop_waves(cands, lambda w: w.join(scores, ["qid", "rank"]), threshold=0.6, top_k=20)
    return b.select("qid", "rank", r6("c").alias("c"))
