"""Calibration (G) and score-array (F) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.functions import text as tx
from kestrel.operators import calibration as cal
from kestrel.operators import retrieval as rt
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.plans.oracle import register, sql


def edges_sql(n: int) -> str:
    return f"list_append(list_transform(range({n}), lambda i: CAST(i AS DOUBLE) * (1.0::DOUBLE / {n})), 1.0::DOUBLE)"


def bin_sql(p: str, n: int = 15) -> str:
    return f"(len(list_filter({edges_sql(n)}, lambda e: e < {p})) - 1)"


def ece_sql(src: str, group: str, y: str, p: str, n: int = 15) -> str:
    """Per-group ECE over ``src`` (a CTE name or subquery)."""
    return f"""(SELECT {group}, round(sum(CASE WHEN nb > 0 THEN nb / tot * abs(sp / nb - sy / nb) ELSE 0 END), 6) AS ece
      FROM (SELECT {group}, b, count(*) FILTER (WHERE b >= 0 AND b < {n}) AS nb,
                   sum({p}) FILTER (WHERE b >= 0 AND b < {n}) AS sp,
                   sum({y}) FILTER (WHERE b >= 0 AND b < {n}) AS sy,
                   sum(count(*)) OVER (PARTITION BY {group}) AS tot
            FROM (SELECT *, {bin_sql(p, n)} AS b FROM {src}) GROUP BY {group}, b)
      GROUP BY {group})"""


def auroc_sql(src: str, group: str, y: str, p: str) -> str:
    return f"""(SELECT {group}, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
          THEN sum(neg * (above + pos / 2.0)) / (sum(pos) * sum(neg)) END, 6) AS auroc
      FROM (SELECT {group}, pv, pos, neg,
                   coalesce(sum(pos) OVER (PARTITION BY {group} ORDER BY pv DESC
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
            FROM (SELECT {group}, CAST({p} AS DOUBLE) AS pv, sum({y}) AS pos, sum(1 - {y}) AS neg
                  FROM {src} GROUP BY {group}, pv))
      GROUP BY {group})"""


NLL_SQL = "-avg({y} * ln(least(greatest({p}, 1e-15), 1 - 1e-15)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-15), 1 - 1e-15)))"


# ---------------------------------------------------------------------------
# G1 – G7 on fx_preds (dataset = language)
# ---------------------------------------------------------------------------

@query("g1_reliability_bins", sql(f"""
SELECT dataset, CAST(b AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y
FROM (SELECT dataset, p, y, {bin_sql('p')} AS b FROM fx_preds) WHERE b >= 0 AND b < 15
GROUP BY dataset, b""", "fx_preds"))
def g1(spark, d):
    r = cal.reliability_bins(fx.preds(spark, d), "y", "p", 15, ["dataset"])
    return r.select("dataset", "bin", "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query("g2_ece", sql("SELECT * FROM " + ece_sql("fx_preds", "dataset", "y", "p"), "fx_preds"))
def g2(spark, d):
    e = cal.ece(fx.preds(spark, d), "y", "p", 15, ["dataset"])
    return e.select("dataset", r6("ece").alias("ece"))


@query("g3_brier", sql("SELECT dataset, round(avg(pow(p - y, 2)), 6) AS brier FROM fx_preds GROUP BY dataset", "fx_preds"))
def g3(spark, d):
    return cal.brier(fx.preds(spark, d), "y", "p", ["dataset"]).select("dataset", r6("brier").alias("brier"))


@query("g4_auroc", sql("SELECT * FROM " + auroc_sql("fx_preds", "dataset", "y", "p"), "fx_preds"))
def g4(spark, d):
    return cal.auroc(fx.preds(spark, d), "y", "p", ["dataset"]).select("dataset", r6("auroc").alias("auroc"))


@query("g5_nll", sql(f"SELECT dataset, round({NLL_SQL.format(y='y', p='p')}, 6) AS nll FROM fx_preds GROUP BY dataset", "fx_preds"))
def g5(spark, d):
    return cal.nll(fx.preds(spark, d), "y", "p", ["dataset"]).select("dataset", r6("nll").alias("nll"))


@query("g6_accuracy_with_abstain", sql("""
SELECT dataset, round(sum(CASE WHEN NOT contains(lower(y_pred), 'no answer') THEN y ELSE 0 END) / count(*), 6) AS acc,
       round(avg(CASE WHEN contains(lower(y_pred), 'no answer') THEN 1.0 ELSE 0.0 END), 6) AS na
FROM fx_preds GROUP BY dataset""", "fx_preds"))
def g6(spark, d):
    p = fx.preds(spark, d).withColumn("abst", tx.is_abstain("y_pred"))
    r = cal.accuracy_with_abstain(p, "y", "abst", ["dataset"])
    return r.select("dataset", r6("acc").alias("acc"), r6("na").alias("na"))


PARSE_SQL = """CASE WHEN c_type = 'ling' THEN (list_position({labels}, c_raw) - 1) / 10.0
  WHEN c_type = 'number' THEN CASE
     WHEN TRY_CAST(c_raw AS DOUBLE) = floor(TRY_CAST(c_raw AS DOUBLE)) AND TRY_CAST(c_raw AS DOUBLE) BETWEEN 0 AND 10
       THEN (TRY_CAST(c_raw AS DOUBLE) * (1.0::DOUBLE / 11) + CASE WHEN TRY_CAST(c_raw AS DOUBLE) + 1 >= 11 THEN 1.0::DOUBLE
             ELSE (TRY_CAST(c_raw AS DOUBLE) + 1) * (1.0::DOUBLE / 11) END) / 2
     WHEN TRY_CAST(c_raw AS DOUBLE) <> floor(TRY_CAST(c_raw AS DOUBLE)) THEN TRY_CAST(c_raw AS DOUBLE) / 10 END
  ELSE coalesce(TRY_CAST(split_part(c_raw, ' (', 1) AS DOUBLE) / 100, TRY_CAST(c_raw AS DOUBLE)) END"""


def parse_sql() -> str:
    from kestrel.plans.oracle import LABELS_SQL
    return PARSE_SQL.format(labels=LABELS_SQL)


register("fx_eval", ["fx_preds"], f"""SELECT dataset, y, ({parse_sql()}) AS p,
  contains(lower(y_pred), 'no answer') AS na FROM fx_preds""")
register("fx_eval_kept", ["fx_eval"], "SELECT * FROM fx_eval WHERE NOT na")


@query("g7_evaluate_predictions", sql(f"""
SELECT a.dataset, round(a.acc, 6) AS acc, e.ece, round(k.brier, 6) AS brier, round(k.nll, 6) AS nll,
       round(a.na, 6) AS na, au.auroc
FROM (SELECT dataset, sum(CASE WHEN NOT na THEN y ELSE 0 END) / count(*) AS acc,
             avg(CASE WHEN na THEN 1.0 ELSE 0.0 END) AS na FROM fx_eval GROUP BY dataset) a
LEFT JOIN (SELECT dataset, avg(pow(p - y, 2)) AS brier, {NLL_SQL.format(y='y', p='p')} AS nll
           FROM fx_eval_kept GROUP BY dataset) k USING (dataset)
LEFT JOIN {ece_sql('fx_eval_kept', 'dataset', 'y', 'p')} e USING (dataset)
LEFT JOIN {auroc_sql('fx_eval_kept', 'dataset', 'y', 'p')} au USING (dataset)""", "fx_eval_kept"))
def g7(spark, d):
    r = cal.evaluate_predictions(fx.preds(spark, d), group=["dataset"])
    return r.select("dataset", *[r6(c).alias(c) for c in ["acc", "ece", "brier", "nll", "na", "auroc"]])


# ---------------------------------------------------------------------------
# G8 – G11 multiclass on fx_logits
# ---------------------------------------------------------------------------

SOFTMAX_SQL = """list_transform({l}, lambda v: exp(v - list_max({l})) / list_sum(list_transform({l}, lambda w: exp(w - list_max({l})))))"""
LSE_SQL = "(list_max({l}) + ln(list_sum(list_transform({l}, lambda w: exp(w - list_max({l}))))))"
ARGMAX_SQL = "(list_position({l}, list_max({l})) - 1)"

register("fx_mc", ["fx_logits"], f"""SELECT id, y, logits, {SOFTMAX_SQL.format(l='logits')} AS pr,
  {ARGMAX_SQL.format(l='logits')} AS pred, {LSE_SQL.format(l='logits')} - logits[y + 1] AS ce FROM fx_logits""")
register("fx_mc2", ["fx_mc"], """SELECT *, list_max(pr) AS conf, CAST(pred = y AS DOUBLE) AS correct,
  list_sum(list_transform(pr, lambda v, i: pow(v - CASE WHEN i - 1 = y THEN 1.0 ELSE 0.0 END, 2))) AS sq,
  1 AS g FROM fx_mc""")


@query("g8_multiclass_brier", sql("SELECT round(avg(sq), 6) AS brier FROM fx_mc2", "fx_mc2"))
def g8(spark, d):
    return cal.multiclass_metrics(fx.logits(spark, d), "logits", "y").select(r6("brier").alias("brier"))


@query("g9_top1_ece", sql("SELECT ece FROM " + ece_sql("fx_mc2", "g", "correct", "conf"), "fx_mc2"))
def g9(spark, d):
    return cal.multiclass_metrics(fx.logits(spark, d), "logits", "y").select(r6("ece").alias("ece"))


@query("g10_multiclass_acc_ce", sql(
    "SELECT count(*) AS n, round(avg(correct), 6) AS acc, round(avg(ce), 6) AS loss FROM fx_mc2", "fx_mc2"))
def g10(spark, d):
    r = cal.multiclass_metrics(fx.logits(spark, d), "logits", "y")
    return r.select("n", r6("acc").alias("acc"), r6("loss").alias("loss"))


@query("g10b_label_subset_acc_ce", sql(f"""
SELECT count(*) AS n, round(avg(CAST({ARGMAX_SQL.format(l='s')} = yy AS DOUBLE)), 6) AS acc,
       round(avg({LSE_SQL.format(l='s')} - s[yy + 1]), 6) AS loss
FROM (SELECT [logits[3], logits[5], logits[8]] AS s, y % 3 AS yy FROM fx_logits)""", "fx_logits"))
def g10b(spark, d):
    lg = fx.logits(spark, d).withColumn("yy", F.col("y") % 3)
    r = cal.label_subset_metrics(lg, "logits", "yy", [2, 4, 7])
    return r.select("n", r6("acc").alias("acc"), r6("loss").alias("loss"))


register("fx_soft", ["fx_logits"], f"""SELECT *, {SOFTMAX_SQL.format(l='l2')} AS pr, {LSE_SQL.format(l='l2')} AS lse,
  {ARGMAX_SQL.format(l='l2')} AS pred, 1 AS g
  FROM (SELECT id, list_slice(logits, 1, 2) AS l2, y / 10.0 AS v FROM fx_logits)""")
register("fx_soft2", ["fx_soft"], """SELECT *, list_max(pr) AS conf,
  CASE WHEN pred = 0 THEN v ELSE 1 - v END AS corr FROM fx_soft""")


@query("g11_soft_label_metrics", sql(f"""
SELECT count(*) AS n, round(avg(CAST(pred = CASE WHEN v >= 1 - v THEN 0 ELSE 1 END AS DOUBLE)), 6) AS acc,
  round(avg(-(v * (l2[1] - lse) + (1 - v) * (l2[2] - lse))), 6) AS loss,
  round(avg(pow(pr[1] - v, 2) + pow(pr[2] - (1 - v), 2)), 6) AS brier,
  (SELECT ece FROM {ece_sql('fx_soft2', 'g', 'corr', 'conf')}) AS ece
FROM fx_soft2""", "fx_soft2"))
def g11(spark, d):
    lg = fx.logits(spark, d).select(F.slice("logits", 1, 2).alias("l2"), "y")
    r = cal.soft_label_metrics(lg, "l2", "y")
    return r.select("n", *[r6(c).alias(c) for c in ["acc", "loss", "brier", "ece"]])


@query("g12_weighted_average", sql("""
SELECT 't' || CAST(t AS VARCHAR) AS name, round(sum(c * prob) / sum(prob), 6) AS value, round(sum(prob), 6) AS weight
FROM fx_attempts GROUP BY t""", "fx_attempts"))
def g12(spark, d):
    a = fx.attempts(spark, d).withColumn("name", F.concat(F.lit("t"), F.col("t").cast("string")))
    r = cal.weighted_average(a, "name", "c", "prob")
    return r.select("name", r6("value").alias("value"), r6("weight").alias("weight"))


@query("g13_class_weights", sql("""
SELECT CAST(cls AS INTEGER) AS cls, round((SELECT count(*) FROM fx_logits) / (8 * coalesce(cnt, 1)), 6) AS weight
FROM range(8) r(cls) LEFT JOIN (SELECT y, count(*) AS cnt FROM fx_logits GROUP BY y) c ON c.y = r.cls""", "fx_logits"))
def g13(spark, d):
    # labels 8 and 9 lie outside the classes and still count in the total
    return cal.class_weights(fx.logits(spark, d), "y", 8).select("cls", r6("weight").alias("weight"))


@query("g14_embedding_spread", sql("""
SELECT label, round(avg(sd), 6) AS spread FROM (
  SELECT label, i, stddev_samp(CAST(embedding[i] AS DOUBLE)) AS sd
  FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i)
GROUP BY label""", None))
def g14(spark, d):
    e = fx.table(spark, d, "embeddings")
    return cal.embedding_spread(e, "embedding", ["label"], dim=64).select("label", r6("spread").alias("spread"))


# fx_pairs: q = embedding, k = partner row's embedding (vec_id xor 1), batch of 16
def pairs(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    partner = e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("k"))
    x = e.withColumn("pid", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id") - 1))
    j = x.join(partner, "pid")
    return j.select((F.col("vec_id") / 16).cast("long").alias("batch_id"), F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("q"), F.col("k").cast("array<double>").alias("k"))


register("fx_pairs", [], """SELECT CAST(floor(e.vec_id / 16) AS BIGINT) AS batch_id, e.vec_id AS row_id,
  CAST(e.embedding AS DOUBLE[]) AS q, CAST(p.embedding AS DOUBLE[]) AS k
  FROM embeddings e JOIN embeddings p ON p.vec_id = CASE WHEN e.vec_id % 2 = 0 THEN e.vec_id + 1 ELSE e.vec_id - 1 END""")


register("g15_s", ["fx_pairs"], """SELECT a.batch_id, a.row_id AS i, b.row_id AS j, list_dot_product(a.q, b.k) / 0.1 AS s
           FROM fx_pairs a JOIN fx_pairs b USING (batch_id)""")
register("g15_r", ["g15_s"], """SELECT batch_id, i, max(s) AS m, max(s) FILTER (WHERE j = i) AS own,
             max(s) FILTER (WHERE j < i) AS before, max(s) FILTER (WHERE j > i) AS after,
             avg(s) AS mean_s FROM g15_s GROUP BY batch_id, i""")
register("g15_l", ["g15_r"], """SELECT r.batch_id, r.i, r.own, r.before, r.after, r.mean_s, r.m + ln(sum(exp(s.s - r.m))) AS lse
      FROM g15_r r JOIN g15_s s ON s.batch_id = r.batch_id AND s.i = r.i
      GROUP BY r.batch_id, r.i, r.own, r.before, r.after, r.mean_s, r.m""")


@query("g15_inbatch_accuracy", sql("""
SELECT batch_id, round(avg(CASE WHEN (before IS NULL OR own > before) AND (after IS NULL OR own >= after) THEN 1.0 ELSE 0.0 END), 6) AS acc,
       round(avg(0.9 * (lse - own) + 0.1 * (lse - mean_s)), 6) AS loss
FROM g15_l GROUP BY batch_id""", "g15_l"))
def g15(spark, d):
    r = cal.inbatch_contrast(pairs(spark, d), "batch_id", "row_id", "q", "k", temperature=0.1, label_smoothing=0.1)
    return r.groupBy("batch_id").agg(r6(F.avg("hit")).alias("acc"), r6(F.avg("loss")).alias("loss"))


register("g16_queue", [], """SELECT label, list(v ORDER BY i) AS qv FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label""")
register("g16_s", ["fx_pairs", "g16_queue"], """SELECT p.row_id, list_dot_product(p.q, p.k) / 0.1 AS pos,
  list(list_dot_product(p.q, g.qv) / 0.1) AS negs FROM fx_pairs p, g16_queue g GROUP BY p.row_id, p.q, p.k""")


@query("g16_queue_contrast", sql("""SELECT row_id, CAST(CASE WHEN pos >= list_max(negs) THEN 1 ELSE 0 END AS DOUBLE) AS hit,
  round(m + ln(exp(pos - m) + list_sum(list_transform(negs, lambda x: exp(x - m)))) - pos, 6) AS loss
  FROM (SELECT *, greatest(pos, list_max(negs)) AS m FROM g16_s)""", "g16_s"))
def g16(spark, d):
    e = fx.table(spark, d, "embeddings")
    queue = rt.pool_vectors(e, "label", "vec_id", "embedding", dim=64).select(F.col("pooled").alias("qv"))
    r = cal.queue_contrast(pairs(spark, d), "q", "k", queue, "qv", temperature=0.1)
    return r.select("row_id", "hit", r6("loss").alias("loss"))


# the queue as it moves: the 64 keys before each batch of 16
register("g16b_s", ["fx_pairs"], """SELECT p.row_id, list_dot_product(p.q, p.k) / 0.1 AS pos,
  list(list_dot_product(p.q, o.k) / 0.1) FILTER (o.row_id IS NOT NULL) AS negs
  FROM (SELECT *, min(pl) OVER (PARTITION BY batch_id) AS first_pl FROM (SELECT *, row_number() OVER (ORDER BY batch_id, row_id) AS pl FROM fx_pairs)) p
  LEFT JOIN (SELECT row_id, k, row_number() OVER (ORDER BY batch_id, row_id) AS pl FROM fx_pairs) o ON o.pl >= p.first_pl - 64 AND o.pl < p.first_pl
  GROUP BY p.row_id, p.q, p.k""")


@query("g16b_moving_queue", sql("""SELECT row_id, CAST(CASE WHEN negs IS NULL OR pos >= list_max(negs) THEN 1 ELSE 0 END AS DOUBLE) AS hit,
  round(m + ln(exp(pos - m) + coalesce(list_sum(list_transform(negs, lambda x: exp(x - m))), 0)) - pos, 6) + 0.0 AS loss
  FROM (SELECT *, greatest(pos, coalesce(list_max(negs), pos)) AS m FROM g16b_s)""", "g16b_s"))
def g16b(spark, d):
    r = cal.moving_queue_contrast(pairs(spark, d), "batch_id", "row_id", "q", "k", 64, temperature=0.1, block=50)
    return r.select("row_id", "hit", (r6("loss") + F.lit(0.0)).alias("loss"))


# ---------------------------------------------------------------------------
# F1 – F7
# ---------------------------------------------------------------------------

@query("f1_softmax", sql("""
SELECT id, CAST(i - 1 AS INTEGER) AS cls, round(p, 6) AS prob FROM (
  SELECT id, unnest(list_transform(logits, lambda v: exp((v - list_max(logits)) / 1.5)
                 / list_sum(list_transform(logits, lambda w: exp((w - list_max(logits)) / 1.5))))) AS p,
         unnest(range(1, 12)) AS i FROM fx_logits)""", "fx_logits"))
def f1(spark, d):
    x = fx.logits(spark, d).select("id", ar.softmax("logits", 1.5).alias("p"))
    return x.select("id", F.posexplode("p").alias("cls", "prob")).select(
        "id", F.col("cls").cast("int").alias("cls"), r6("prob").alias("prob"))


@query("f2_label_subset_prob", sql("""
SELECT id, round(exp(s[2] - list_max(s)) / list_sum(list_transform(s, lambda w: exp(w - list_max(s)))), 6) AS prob
FROM (SELECT id, [logits[4], logits[8]] AS s FROM fx_logits)""", "fx_logits"))
def f2(spark, d):
    return fx.logits(spark, d).select("id", r6(ar.label_subset_prob("logits", [3, 7], 1)).alias("prob"))


@query("f3_argmax_class", sql(f"SELECT id, CAST({ARGMAX_SQL.format(l='logits')} AS INTEGER) AS cls FROM fx_logits", "fx_logits"))
def f3(spark, d):
    return fx.logits(spark, d).select("id", ar.argmax_class("logits").alias("cls"))


@query("f4_positive_prob", sql(f"""
SELECT id, round(pr[2], 6) AS p_plain, round(pr[1], 6) AS p_temp FROM (
  SELECT id, {SOFTMAX_SQL.format(l='l2')} AS pr FROM (SELECT id, list_slice(logits, 1, 2) AS l2 FROM fx_logits))""", "fx_logits"))
def f4(spark, d):
    pr = ar.softmax(F.slice("logits", 1, 2))
    x = fx.logits(spark, d).select("id", pr.alias("pr"))
    return x.select("id", r6(ar.positive_prob("pr", 1)).alias("p_plain"), r6(ar.positive_prob("pr", 0)).alias("p_temp"))


@query("f5_fourier_features", sql("""
SELECT round(temperature, 6) AS temperature, CAST(k AS INTEGER) AS k, count(*) AS n,
  round(CASE WHEN k < 6 THEN sin(temperature * pow(2.0, k) * (2 * pi() / 1.0))
             ELSE cos(temperature * pow(2.0, k - 6) * (2 * pi() / 1.0)) END, 6) + 0.0 AS value
FROM (SELECT temperature, unnest(range(12)) AS k FROM fx_attempts) GROUP BY temperature, k""", "fx_attempts"))
def f5(spark, d):
    a = fx.attempts(spark, d).select("temperature", ar.fourier_features("temperature").alias("ff"))
    x = a.select("temperature", F.posexplode("ff").alias("k", "value"))
    return x.groupBy("temperature", "k").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")) \
        .select(r6("temperature").alias("temperature"), F.col("k").cast("int").alias("k"), "n", r6("value").alias("value"))


# per-position distributions from the halves of embeddings (4 positions per row)
def div_table(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select((F.col("vec_id") / 4).cast("long").alias("row_id"), "vec_id",
                    ar.softmax(F.slice("embedding", 1, 32)).alias("p"),
                    ar.softmax(F.slice("embedding", 33, 32)).alias("ref"),
                    F.when(F.col("label") == 0, F.lit(-100)).otherwise(F.col("label")).alias("lab"))


def _kl_sql(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * (ln(z[1]) - ln(z[2])) ELSE 0 END))"


register("fx_div", [], f"""SELECT CAST(floor(vec_id / 4) AS BIGINT) AS row_id, vec_id,
  {SOFTMAX_SQL.format(l='CAST(list_slice(embedding, 1, 32) AS DOUBLE[])')} AS p,
  {SOFTMAX_SQL.format(l='CAST(list_slice(embedding, 33, 64) AS DOUBLE[])')} AS ref,
  CASE WHEN label = 0 THEN -100 ELSE label END AS lab FROM embeddings""")
register("fx_div2", ["fx_div"], f"""SELECT *, list_transform(list_zip(p, ref), lambda z: (z[1] + z[2]) / 2) AS mix FROM fx_div""")


@query("f6_distribution_divergence", sql(f"""
SELECT kind, round(avg(v), 6) AS value FROM (
  SELECT 'reverse_kl' AS kind, row_id, sum(CASE WHEN lab <> -100 THEN {_kl_sql('p', 'ref')} ELSE 0 END) AS v FROM fx_div2 GROUP BY row_id
  UNION ALL
  SELECT 'forward_kl', row_id, sum(CASE WHEN lab <> -100 THEN {_kl_sql('ref', 'p')} ELSE 0 END) FROM fx_div2 GROUP BY row_id
  UNION ALL
  SELECT 'jsd', row_id, sum(CASE WHEN lab <> -100 THEN ({_kl_sql('p', 'mix')} + {_kl_sql('ref', 'mix')}) / 2 ELSE 0 END)
  FROM fx_div2 GROUP BY row_id) GROUP BY kind""", "fx_div2"))
def f6(spark, d):
    r = cal.divergence(div_table(spark, d), "row_id", "p", "ref", "lab")
    return r.select("kind", r6("value").alias("value"))


@query("f7_apply_temperature", sql("""
SELECT id, CAST(i - 1 AS INTEGER) AS cls, round(v, 6) AS value FROM (
  SELECT id, unnest(list_transform(logits, lambda x: x / exp(0.3))) AS v, unnest(range(1, 12)) AS i FROM fx_logits)""", "fx_logits"))
def f7(spark, d):
    x = fx.logits(spark, d).select("id", ar.apply_temperature("logits", 0.3).alias("v"))
    return x.select("id", F.posexplode("v").alias("cls", "value")).select(
        "id", F.col("cls").cast("int").alias("cls"), r6("value").alias("value"))
