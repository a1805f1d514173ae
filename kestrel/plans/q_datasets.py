"""Training-table (H) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import arrays as ar
from kestrel.functions.hashing import uniform
from kestrel.operators import datasets as ds
from kestrel.operators import subwords as sw
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query, r6
from kestrel.plans.oracle import register, sql, u
from kestrel.session import materialize

SEED = 7
CHUNK, OFFSET = 64, 5


def okey_sql(seed, key):
    return f"md5('{seed}' || '-' || CAST({key} AS VARCHAR))"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


@query("h1_shuffle", sql(f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {okey_sql(SEED, 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos
  FROM documents"""))
def h1(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return ds.shuffle(docs, "doc_id", SEED)


@query("h2_head_n", sql(f"SELECT doc_id FROM documents ORDER BY {okey_sql(SEED, 'doc_id')}, doc_id LIMIT 100"))
def h2(spark, d):
    return ds.head_n(fx.table(spark, d, "documents").select("doc_id"), "doc_id", SEED, 100)


@query("h3_split_exact", sql(f"""SELECT doc_id, CASE WHEN pos < floor({dbl(0.2)} * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY {okey_sql(SEED, 'doc_id')}, doc_id) - 1 AS pos FROM documents)"""))
def h3(spark, d):
    return ds.split_exact(fx.table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, SEED)


@query("h4_schedule_join", sql("""SELECT qid, rank, t, CAST(t_idx AS BIGINT) AS t_idx, s.temperature FROM (
  SELECT qid, rank, t, (row_number() OVER (ORDER BY qid, rank, t) - 1) // ((SELECT count(*) FROM fx_attempts) // 6) AS t_idx
  FROM fx_attempts) a JOIN (SELECT DISTINCT t AS ti, temperature FROM fx_attempts) s ON s.ti = a.t_idx""", "fx_attempts"))
def h4(spark, d):
    a = fx.attempts(spark, d)
    rows = a.select("qid", "rank", "t")
    temps = a.select(F.col("t").cast("long").alias("t_idx"), "temperature").distinct()
    n = rows.count()
    return ds.schedule_join(rows, [F.col("qid"), F.col("rank"), F.col("t")], temps, n // 6)


def samples(spark, d, seed=SEED, n=10):
    lab = fx.table(spark, d, "labels").select("doc_id", "quality")
    f = ds.fanout(lab, n)
    corr = (uniform(f"s{seed}", F.col("doc_id"), F.col("sample_id")) < (0.3 + 0.4 * F.col("quality"))).cast("int")
    return f.select("doc_id", "sample_id", corr.alias("correct"))


def samples_sql(seed=SEED, n=10):
    return f"""SELECT doc_id, CAST(sample_id AS INTEGER) AS sample_id,
  CAST({u(f's{seed}', 'doc_id', 'sample_id')} < (0.3 + 0.4 * quality) AS INTEGER) AS correct
  FROM (SELECT doc_id, quality, unnest(range({n})) AS sample_id FROM labels)"""


register("fx_samples", [], samples_sql())


@query("h5_fanout", sql("SELECT * FROM fx_samples", "fx_samples"))
def h5(spark, d):
    return samples(spark, d)


@query("h6_vote_label", sql("SELECT doc_id, CAST(sum(correct) AS INTEGER) AS votes, count(*) AS n_samples FROM fx_samples GROUP BY doc_id",
                            "fx_samples"))
def h6(spark, d):
    return ds.vote_label(samples(spark, d), ["doc_id"])


@query("h7_soft_rows", sql("""SELECT doc_id, l AS label, round(w, 6) AS weight FROM (
  SELECT doc_id, 1 AS l, sum(correct) / 10.0 AS w FROM fx_samples GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 1 - sum(correct) / 10.0 FROM fx_samples GROUP BY doc_id)""", "fx_samples"))
def h7(spark, d):
    v = ds.vote_label(samples(spark, d), ["doc_id"]).withColumn("v", F.col("votes") / 10.0)
    s = ds.soft_rows(v, "v")
    return s.select("doc_id", "label", r6("weight").alias("weight"))


# token packing ---------------------------------------------------------------

register("fx_flat", ["fx_tokens"], """SELECT doc_id, tok, start + i AS gpos FROM (
  SELECT doc_id, start, unnest(tokens) AS tok, unnest(range(len(tokens))) AS i FROM (
    SELECT doc_id, tokens, coalesce(sum(len(tokens)) OVER (ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM fx_tokens))""")
register("fx_chunks", ["fx_flat"], f"""SELECT CAST((gpos - {OFFSET}) // {CHUNK} AS BIGINT) AS chunk_id,
  list(tok ORDER BY gpos) AS tokens FROM fx_flat
  WHERE gpos >= {OFFSET} AND (gpos - {OFFSET}) // {CHUNK} < ((SELECT count(*) FROM fx_flat) - {OFFSET}) // {CHUNK}
  GROUP BY 1""")


def chunks(spark, d):
    return ds.pack_chunks(fx.tokens(spark, d), "doc_id", "tokens", CHUNK, OFFSET)


@query("h8_pack_chunks", sql("SELECT chunk_id, CAST(len(tokens) AS INTEGER) AS n, md5(array_to_string(tokens, ',')) AS tokens_md5 FROM fx_chunks",
                             "fx_chunks"))
def h8(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", ",")).alias("tokens_md5"))


def crop_sql(side, seed=1, lo=0.1, hi=0.5):
    ratio = f"({dbl(lo)} + {u(f'crop-ratio-{seed}', 'chunk_id', repr(side))} * {dbl(hi - lo)})"
    length = f"CAST(floor(len(tokens) * {ratio}) AS INTEGER)"
    start = f"CAST(floor({u(f'crop-start-{seed}', 'chunk_id', repr(side))} * (len(tokens) - {length} + 1)) AS INTEGER)"
    return start, length


_qs, _ql = crop_sql("q")
_ks, _kl = crop_sql("k")
register("fx_crops", ["fx_chunks"], f"""SELECT chunk_id, {_qs} AS q_start, {_ql} AS q_len, {_ks} AS k_start, {_kl} AS k_len,
  list_slice(tokens, {_qs} + 1, {_qs} + {_ql}) AS q_tokens, list_slice(tokens, {_ks} + 1, {_ks} + {_kl}) AS k_tokens
  FROM fx_chunks""")


def crops(spark, d):
    return ds.crop_pairs(chunks(spark, d), "chunk_id", "tokens", 0.1, 0.5, seed=1)


@query("h9_crop_pairs", sql("""SELECT chunk_id, q_start, q_len, k_start, k_len, md5(array_to_string(q_tokens, ',')) AS q_md5,
  md5(array_to_string(k_tokens, ',')) AS k_md5 FROM fx_crops""", "fx_crops"))
def h9(spark, d):
    c = crops(spark, d)
    return c.select("chunk_id", "q_start", "q_len", "k_start", "k_len", F.md5(F.array_join("q_tokens", ",")).alias("q_md5"),
                    F.md5(F.array_join("k_tokens", ",")).alias("k_md5"))


P_AUG = 0.1
register("fx_aug", ["fx_chunks"], f"""SELECT chunk_id, i - 1 AS i, tok, {u('aug-3', 'chunk_id', 'i - 1')} AS ua,
  {u('aug-s-3', 'chunk_id', 'i - 1')} AS us,
  CAST(0 + (('0x' || substr(md5('aug-r-3' || '-' || CAST(chunk_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR)), 1, 8))::BIGINT % 30000) AS INTEGER) AS rep
  FROM (SELECT chunk_id, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS i FROM fx_chunks)""")
register("fx_aug_shuf", ["fx_aug"], f"""SELECT a.chunk_id, a.i, b.tok AS tok FROM
  (SELECT chunk_id, i, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS r FROM fx_aug WHERE ua < {P_AUG}) a
  JOIN (SELECT chunk_id, tok, row_number() OVER (PARTITION BY chunk_id ORDER BY us, i) AS r FROM fx_aug WHERE ua < {P_AUG}) b
  USING (chunk_id, r)""")


@query("h10_augment_tokens", sql(f"""
SELECT chunk_id, 'delete' AS mode, count(*) FILTER (WHERE ua > {P_AUG}) AS n,
       md5(coalesce(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY i) FILTER (WHERE ua > {P_AUG}), '')) AS tokens_md5
FROM fx_aug GROUP BY chunk_id
UNION ALL
SELECT chunk_id, 'mask', count(*), md5(string_agg(CAST(CASE WHEN ua > {P_AUG} THEN tok ELSE 0 END AS VARCHAR), ',' ORDER BY i))
FROM fx_aug GROUP BY chunk_id
UNION ALL
SELECT chunk_id, 'replace', count(*), md5(string_agg(CAST(CASE WHEN ua > {P_AUG} THEN tok ELSE rep END AS VARCHAR), ',' ORDER BY i))
FROM fx_aug GROUP BY chunk_id
UNION ALL
SELECT a.chunk_id, 'shuffle', count(*), md5(string_agg(CAST(coalesce(s.tok, a.tok) AS VARCHAR), ',' ORDER BY a.i))
FROM fx_aug a LEFT JOIN fx_aug_shuf s USING (chunk_id, i) GROUP BY a.chunk_id""", "fx_aug", "fx_aug_shuf"))
def h10(spark, d):
    """All modes in one pass over the written chunks, the draws made once."""
    modes = ["delete", "mask", "replace", "shuffle"]
    c = materialize(chunks(spark, d).withColumn("draws", ds.augment_draws("tokens", 3, F.col("chunk_id"))))
    made = c.select("chunk_id", *[ds.augment_tokens("tokens", mode, P_AUG, 3, F.col("chunk_id"), mask_id=0, min_id=0, max_id=29999,
                                                    draws="draws").alias(mode) for mode in modes])
    rows = made.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(mode).alias("mode"), F.col(mode).alias("_t")) for mode in modes])))
    return rows.select("chunk_id", "mode", F.size("_t").cast("long").alias("n"), F.md5(F.array_join("_t", ",")).alias("tokens_md5"))


@query("h11_add_bos_eos", sql("""SELECT chunk_id, md5(array_to_string(list_concat([1], tokens, [2]), ',')) AS both_md5,
  md5(array_to_string(list_concat(tokens, [2]), ',')) AS eos_md5 FROM fx_chunks""", "fx_chunks"))
def h11(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", F.md5(F.array_join(ar.add_bos_eos("tokens", 1, 2), ",")).alias("both_md5"),
                    F.md5(F.array_join(ar.add_bos_eos("tokens", None, 2), ",")).alias("eos_md5"))


@query("h12_pad_with_mask", sql("""SELECT chunk_id, md5(array_to_string(list_concat(q_tokens, list_resize([]::INTEGER[], mx - len(q_tokens), 0)), ',')) AS ids_md5,
  md5(array_to_string(list_concat(list_resize([]::INTEGER[], len(q_tokens), 1), list_resize([]::INTEGER[], mx - len(q_tokens), 0)), ',')) AS mask_md5,
  CAST(mx AS INTEGER) AS width FROM (SELECT *, max(len(q_tokens)) OVER (PARTITION BY chunk_id // 8) AS mx FROM fx_crops)""", "fx_crops"))
def h12(spark, d):
    c = crops(spark, d).withColumn("batch", (F.col("chunk_id") / 8).cast("long"))
    p = ds.pad_with_mask(c, "q_tokens", "batch")
    return p.select("chunk_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("attention_mask", ",")).alias("mask_md5"), F.size("input_ids").alias("width"))


@query("h13_loss_labels", sql("""SELECT chunk_id, md5(array_to_string(list_concat(list_resize([]::INTEGER[], len(q_tokens), -100), k_tokens), ',')) AS labels_md5
  FROM fx_crops""", "fx_crops"))
def h13(spark, d):
    c = crops(spark, d)
    return c.select("chunk_id", F.md5(F.array_join(ar.loss_labels("q_tokens", "k_tokens"), ",")).alias("labels_md5"))


register("fx_mix", [], """SELECT lang, n, w / sum(w) OVER () AS prob FROM (
  SELECT lang, n, pow(n / sum(n) OVER (), 0.5) AS w FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))""")


@query("h14_mixture_probs", sql("SELECT lang, n, round(prob, 6) AS prob FROM fx_mix", "fx_mix"))
def h14(spark, d):
    docs = fx.table(spark, d, "documents")
    return ds.mixture_probs(docs, "lang", 0.5).select("lang", "n", r6("prob").alias("prob"))


register("fx_mixcum", ["fx_mix"], """SELECT lang, n, row_number() OVER (ORDER BY lang) - 1 AS di,
  sum(prob) OVER (ORDER BY lang ROWS UNBOUNDED PRECEDING) AS cum FROM fx_mix""")
register("fx_draws", ["fx_mixcum"], f"""SELECT draw_id,
  (SELECT count(*) FROM fx_mixcum c WHERE c.di < (SELECT max(di) FROM fx_mixcum) AND c.cum <= {u('mix-d-0', 'draw_id')}) AS di,
  {u('mix-r-0', 'draw_id')} AS u2 FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS draw_id)""")


@query("h14b_mixture_sample", sql("""SELECT d.draw_id, c.lang, x.doc_id FROM fx_draws d JOIN fx_mixcum c USING (di)
  JOIN (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ri FROM documents) x
    ON x.lang = c.lang AND x.ri = CAST(floor(d.u2 * c.n) AS BIGINT)""", "fx_draws"))
def h14b(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    n = docs.count()
    s = ds.mixture_sample(docs, "lang", "doc_id", 0.5, n, seed=0)
    return s.select("draw_id", "lang", "doc_id")


# contrastive examples: positives = hits, hard = non-hits ranked < 10, random negatives = non-hits ranked >= 10
def contrast_table(spark, d):
    from kestrel.plans.q_rerank import hits
    h = hits(spark, d)
    ctx = fx.run(spark, d).select("qid", "pid", "rank").join(fx.corpus(spark, d), "pid")
    x = ctx.join(h.select("qid", "rank", "hit"), ["qid", "rank"])
    item = F.struct(F.col("rank"), F.col("title"), F.col("text"))

    def arr(cond):
        return F.transform(F.sort_array(F.collect_list(F.when(cond, item))),
                           lambda s: F.struct(s["title"].alias("title"), s["text"].alias("text")))
    g = x.groupBy("qid").agg(arr(F.col("hit")).alias("positive_ctxs"),
                             arr(~F.col("hit") & (F.col("rank") >= 10)).alias("negative_ctxs"),
                             arr(~F.col("hit") & (F.col("rank") < 10)).alias("hard_negative_ctxs"))
    q = fx.queries(spark, d).select("qid", F.col("q").alias("question"))
    return g.join(q, "qid").where(F.size("positive_ctxs") > 0)


def _lst(cond):
    return (f"list(CASE WHEN length(coalesce(title, '')) > 0 THEN title || ' ' || text ELSE text END ORDER BY rank) "
            f"FILTER (WHERE {cond})")


register("fx_contrast", ["fx_ctx", "fx_hits", "fx_queries"], f"""SELECT c.qid, {_lst('h.hit')} AS pos,
  coalesce({_lst('NOT h.hit AND c.rank >= 10')}, []) AS neg, coalesce({_lst('NOT h.hit AND c.rank < 10')}, []) AS hard
  FROM fx_ctx c JOIN fx_hits h USING (qid, rank) GROUP BY c.qid HAVING count(*) FILTER (WHERE h.hit) > 0""")
register("fx_contrast2", ["fx_contrast"], f"""SELECT qid, pos, neg, hard,
  least((SELECT count(*) FROM range(4) j(j) WHERE {u('hard-0', 'qid', 'j')} < 0.5), greatest(len(hard) - 1, 0)) AS n_hard,
  list_slice(hard, 2, len(hard)) AS hp FROM fx_contrast""")


def _sample_sql(arr, n, tag):
    return (f"list_transform(list_slice(list_sort(list_transform({arr}, lambda c, i: {{'h': {u(tag, 'qid', 'i - 1')}, 'i': i - 1, 'p': c}})), 1, {n}), "
            f"lambda s: s.p)")


@query("h15_pick_contrast", sql(f"""SELECT qid, md5(pos[CAST(floor({u('gold-0', 'qid')} * len(pos)) AS INTEGER) + 1]) AS gold_md5,
  CAST(n_hard AS INTEGER) AS n_hard, CAST(least(4 - n_hard, len(neg)) AS INTEGER) AS n_rand,
  md5(array_to_string(list_concat({_sample_sql('neg', 'least(4 - n_hard, len(neg))', 'rneg-0')}, {_sample_sql('hp', 'n_hard', 'hneg-0')}), '|')) AS negatives_md5
  FROM fx_contrast2""", "fx_contrast2"))
def h15(spark, d):
    t = contrast_table(spark, d)
    p = ds.pick_contrast(t, "qid", n_neg=4, hard_ratio=0.5, hard_min=1, training=True, seed=0)
    return p.select("qid", F.md5("gold").alias("gold_md5"), F.col("n_hard").cast("int").alias("n_hard"),
                    F.col("n_rand").cast("int").alias("n_rand"), F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


@query("h16_union_samples", sql(f"""SELECT *, 'a' AS part FROM ({samples_sql(SEED, 10)})
  UNION ALL SELECT *, 'b' FROM ({samples_sql(SEED + 1, 5)})"""))
def h16(spark, d):
    a = samples(spark, d).withColumn("part", F.lit("a"))
    b = samples(spark, d, SEED + 1, 5).withColumn("part", F.lit("b"))
    return ds.union_samples(a, b)


@query("h17_truncate_tokens", sql("""SELECT doc_id, CAST(len(list_slice(tokens, 1, 32)) AS INTEGER) AS n,
  md5(array_to_string(list_slice(tokens, 1, 32), ',')) AS tokens_md5 FROM fx_tokens""", "fx_tokens"))
def h17(spark, d):
    t = fx.tokens(spark, d).select("doc_id", ar.truncate_tokens("tokens", 32).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", ",")).alias("tokens_md5"))


def byte_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def subwords(spark, d):
    return sw.encode_subwords(fx.table(spark, d, "documents").select("doc_id", "text"), "text", byte_ranks())


@query("h12b_subword_batch", None)
def h12b(spark, d):
    """Texts cut at 200 sub-words, batches of 8 documents padded."""
    t = subwords(spark, d).select("doc_id", ar.truncate_tokens(F.coalesce("tokens", F.array().cast("array<int>")), 200).alias("t"),
                                  F.floor(F.col("doc_id") / 8).alias("batch"))
    p = ds.pad_with_mask(t, "t", "batch")
    return p.select("doc_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("attention_mask", ",")).alias("mask_md5"), F.size("input_ids").alias("width"))


@query("h17b_subword_truncate", None)
def h17b(spark, d):
    """Sub-words of whole texts, and the 512 that a reader takes."""
    t = subwords(spark, d).select("doc_id", F.coalesce("tokens", F.array().cast("array<int>")).alias("t"))
    cut = ar.truncate_tokens("t", 512)
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(cut).alias("n"), F.md5(F.array_join(cut, ",")).alias("tokens_md5"))


@query("h17c_subword_round_trip", sql("SELECT doc_id, md5(text) AS text_md5 FROM documents"))
def h17c(spark, d):
    """Whole texts to ids and back."""
    ids = subwords(spark, d).select("doc_id", "tokens")
    return sw.decode_subwords(ids, "tokens", byte_ranks()).select("doc_id", F.md5("text").alias("text_md5"))
