"""Training-table construction.

Randomness is always a hash of (seed, key) — see ``kestrel.functions.hashing``
— so a recomputed partition draws the same numbers. Global positions
(shuffles, exact splits, schedules, token packing) use the two-level prefix
sum of ``kestrel.operators.ordering``; nothing funnels through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.functions.arrays import bind
from kestrel.functions.hashing import hash_int, order_key, uniform
from kestrel.operators.ordering import dense_index, prefix_sums
from kestrel.session import join_null_safe, materialize



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H1 / H2 / H3 ----------------------------------------------------------------

def shuffle(df: DataFrame, key: str, seed: int, out: str = "pos") -> DataFrame:
    """Seeded full shuffle: ``out`` = position in md5(seed-key) order."""
    k = df.withColumn("_h", order_key(seed, F.col(key)))
    return dense_index(k, [F.col("_h"), F.col(key)], out=out).drop("_h")


def head_n(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """First n rows of the seeded shuffle (TakeOrderedAndProject)."""
    return df.orderBy(order_key(seed, F.col(key)), F.col(key)).limit(n)


def split_exact(df: DataFrame, key: str, test_size: float, seed: int) -> DataFrame:
    """Disjoint train/test split with exactly int(test_size · N) test rows."""
    n = df.count()
    n_test = int(test_size * n)
    s = shuffle(df, key, seed, out="_pos")
    return s.withColumn("split", F.when(F.col("_pos") < n_test, "test").otherwise("train")).drop("_pos")


# H4 ---------------------------------------------------------------------------

def schedule_join(rows: DataFrame, order_cols: list, temps: DataFrame, batch: int,
                  t_index: str = "t_idx") -> DataFrame:
    """Row i (in ``order_cols`` order) takes the temperature with index
    i // batch. Requires N % batch == 0 and N / batch == #temperatures."""
    n = rows.count()
    n_t = temps.count()
    if n % batch != 0 or n // batch != n_t:
        raise ValueError(f"schedule mismatch: {n} rows, batch {batch}, {n_t} temperatures")
    idx = dense_index(rows, order_cols, out="_i")
    idx = idx.withColumn(t_index, (F.col("_i") / batch).cast("long")).drop("_i")
    t = temps
    return idx.join(t, t_index)


# H5 / H6 / H7 -------------------------------------------------------------------

def fanout(df: DataFrame, n: int, out: str = "sample_id") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def vote_label(samples: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    """Number of correct samples per key = soft label 0..n."""
    return samples.groupBy(*keys).agg(F.sum(F.col(correct).cast("int")).cast("int").alias("votes"),
                                      F.count(F.lit(1)).alias("n_samples"))


def soft_rows(df: DataFrame, v: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """Soft target v as two weighted hard rows: (1, v) and (0, 1 − v)."""
    pairs = F.array(F.struct(F.lit(1).alias("l"), F.col(v).cast("double").alias("w")),
                    F.struct(F.lit(0).alias("l"), (1 - F.col(v).cast("double")).alias("w")))
    x = df.withColumn("_p", F.explode(pairs))
    return x.withColumn(label, F.col("_p.l")).withColumn(weight, F.col("_p.w")).drop("_p")


# H8 / H9 / H10 -------------------------------------------------------------------

def pack_chunks(df: DataFrame, key: str, tokens: str, chunk_len: int, offset: int,
                materialize_input: bool = True) -> DataFrame:
    """Concatenate every row's tokens in ``key`` order, skip ``offset``
    tokens, cut fixed chunks of ``chunk_len`` and drop the short tail.

    Start positions are a two-level prefix sum over (key, length) only; the
    token arrays join their start back by key. Each row is then sliced into
    the pieces that fall into each chunk it touches (a row may span many
    chunks, a chunk many rows); pieces are regrouped by chunk id — a group
    never holds more than ``chunk_len`` tokens. The input is written once
    (``materialize_input``) because two passes read it.
    """
    L = chunk_len
    src = df.select(F.col(key).alias("_k"), F.col(tokens).alias("_t"))
    if materialize_input:
        src = materialize(src)
    lens = src.select("_k", F.size("_t").cast("long").alias("_len"))
    starts = prefix_sums(lens, [F.col("_k")], ["_len"], prefix="_cum_", inclusive=False) \
        .withColumnRenamed("_cum__len", "_start")
    total = starts.agg(F.max(F.col("_start") + F.col("_len"))).first()[0] or 0
    n_chunks = max(0, (int(total) - offset) // L)
    if n_chunks == 0:
        return df.sparkSession.createDataFrame([], "chunk_id long, tokens array<int>")
    end = F.col("_start") + F.col("_len")
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - offset) / L))
    last = F.least(F.lit(n_chunks - 1), F.floor((end - 1 - offset) / L))
    starts = starts.where((F.col("_len") > 0) & (last >= first) & (end > offset))
    x = src.join(starts.select("_k", "_start", "_len", first.alias("_first"), last.alias("_last")), "_k")
    x = x.select("_t", "_start", "_len", F.explode(F.sequence("_first", "_last")).alias("chunk_id"))
    lo = F.greatest(F.col("_start"), F.lit(offset) + F.col("chunk_id") * L)
    hi = F.least(F.col("_start") + F.col("_len"), F.lit(offset) + (F.col("chunk_id") + 1) * L)
    x = x.select("chunk_id", lo.alias("_lo"), F.slice("_t", (lo - F.col("_start") + 1).cast("int"),
                                                       (hi - lo).cast("int")).alias("_piece"))
    g = x.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("_lo", "_piece"))).alias("_ps"))
    return g.select(F.col("chunk_id").cast("long").alias("chunk_id"),
                    F.flatten(F.transform("_ps", lambda p: p["_piece"])).alias("tokens"))


def random_crop(tokens, ratio_min: float, ratio_max: float, seed, *keys) -> tuple[Column, Column, Column]:
    """(crop, start, length): length = int(len · U(min, max)), start uniform
    over the valid range."""
    t = _c(tokens)
    n = F.size(t)
    ratio = F.lit(ratio_min) + uniform(f"crop-ratio-{seed}", *keys) * (ratio_max - ratio_min)
    length = F.floor(n * ratio).cast("int")
    start = F.floor(uniform(f"crop-start-{seed}", *keys) * (n - length + 1)).cast("int")
    return F.slice(t, start + 1, length), start, length


def crop_pairs(chunks: DataFrame, key: str, tokens: str, ratio_min: float = 0.1,
               ratio_max: float = 0.5, seed: int = 0) -> DataFrame:
    """Two independent crops (q, k) per chunk."""
    q, qs, ql = random_crop(tokens, ratio_min, ratio_max, seed, F.col(key), F.lit("q"))
    k, ks, kl = random_crop(tokens, ratio_min, ratio_max, seed, F.col(key), F.lit("k"))
    return chunks.select(key, q.alias("q_tokens"), qs.alias("q_start"), ql.alias("q_len"),
                         k.alias("k_tokens"), ks.alias("k_start"), kl.alias("k_len"))


def augment_draws(tokens, seed, key) -> Column:
    """The draw of each token that ``augment_tokens`` goes by, as an array:
    for callers who augment one row in several ways."""
    return F.transform(_c(tokens), lambda x, i: uniform(f"aug-{seed}", key, i))


def augment_tokens(tokens, mode: str, p: float, seed, key, mask_id: int = 0,
                   min_id: int = 0, max_id: int = 29999, draws=None) -> Column:
    """delete / replace / mask / shuffle each token with probability p.
    ``draws``: a column of ``augment_draws``, else they are made here."""
    t = _c(tokens)

    def u(i):
        return uniform(f"aug-{seed}", key, i) if draws is None else F.get(_c(draws), i)

    if mode == "delete":
        return F.filter(t, lambda x, i: u(i) > p)
    if mode == "mask":
        return F.transform(t, lambda x, i: F.when(u(i) > p, x).otherwise(F.lit(mask_id)))
    if mode == "replace":
        span = max_id - min_id + 1
        return F.transform(t, lambda x, i: F.when(u(i) > p, x).otherwise(
            (F.lit(min_id) + hash_int(f"aug-r-{seed}", key, i) % span).cast("int")))
    if mode == "shuffle":
        at = F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("v"), (u(i) < p).alias("s")))

        def shuffled(rows):
            chosen = F.filter(rows, lambda r: r["s"])
            mixed = F.array_sort(F.transform(chosen, lambda r: F.struct(
                uniform(f"aug-s-{seed}", key, r["i"]).alias("h"), r["i"].alias("i"), r["v"].alias("v"))))
            moved = F.zip_with(chosen, mixed, lambda r, m: F.struct(r["i"].alias("i"), m["v"].alias("v")))
            stay = F.transform(F.filter(rows, lambda r: ~r["s"]), lambda r: F.struct(r["i"].alias("i"), r["v"].alias("v")))
            return F.transform(F.array_sort(F.concat(moved, stay)), lambda r: r["v"])

        return bind(at, shuffled)
    return t


# H12 -----------------------------------------------------------------------------

def pad_with_mask(df: DataFrame, tokens: str, batch: str, side: str = "right",
                  pad_id: int = 0) -> DataFrame:
    """Pad each row to its batch's longest row; 1/0 mask.

    The batch width is a grouped ``max`` (partial aggregation, so a huge
    batch is never one task) joined back."""
    widths = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_max"))
    x = join_null_safe(df, widths, [batch])
    pad = F.array_repeat(F.lit(pad_id), F.col("_max") - F.size(tokens))
    ones = F.array_repeat(F.lit(1), F.size(tokens))
    zeros = F.array_repeat(F.lit(0), F.col("_max") - F.size(tokens))
    if side == "left":
        ids, mask = F.concat(pad, F.col(tokens)), F.concat(zeros, ones)
    else:
        ids, mask = F.concat(F.col(tokens), pad), F.concat(ones, zeros)
    return x.withColumn("input_ids", ids).withColumn("attention_mask", mask).drop("_max")


# H14 -----------------------------------------------------------------------------

def mixture_probs(df: DataFrame, dataset: str, coeff: float) -> DataFrame:
    """p_d ∝ (n_d / N)^coeff (coeff 0 = uniform over datasets)."""
    n = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # one row per dataset: tiny
    share = F.col("n") / F.sum("n").over(w)
    x = n.withColumn("_w", F.pow(share, F.lit(coeff)))
    return x.select(dataset, "n", (F.col("_w") / F.sum("_w").over(w)).alias("prob"))


def mixture_sample(df: DataFrame, dataset: str, key: str, coeff: float, n_draws: int,
                   seed: int = 0) -> DataFrame:
    """With replacement: draw a dataset by p_d, then a uniform row of it.

    Each dataset owns an interval of [0, 1); intervals are cut at the borders
    of as many equal cells as there are datasets, so a draw finds its dataset
    by an equi-join on the cell and a comparison, and its row by an equi-join
    on (dataset, row index). Rows without dataset are a dataset of their own.
    """
    spark = df.sparkSession
    up_to = Window.orderBy(dataset)  # one row per dataset
    table = mixture_probs(df, dataset, coeff)
    table = (table.withColumn("_hi", F.sum("prob").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_lo", F.coalesce(F.lag("_hi").over(up_to), F.lit(0.0)))
             .withColumn("_cells", F.count(F.lit(1)).over(Window.partitionBy()))
             .withColumn("_hi", F.when(F.lead("_hi").over(up_to).isNotNull(), F.col("_hi"))))  # the last one has no end
    last = F.least(F.floor(F.coalesce("_hi", F.lit(1.0)) * F.col("_cells")), F.col("_cells") - 1)
    table = materialize(table.withColumn("_cell", F.explode(F.sequence(F.least(F.floor(F.col("_lo") * F.col("_cells")), last), last))))
    cells = table.select(F.max("_cells")).first()[0] or 1
    u1 = uniform(f"mix-d-{seed}", F.col("draw_id"))
    draws = (spark.range(n_draws).withColumnRenamed("id", "draw_id").withColumn("_u", u1)
             .withColumn("_cell", F.floor(F.col("_u") * cells)))
    hit = draws.join(table.select("_cell", F.col(dataset).alias("_name"), "n", "_lo", "_hi"), "_cell").where(
        (F.col("_u") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_u") < F.col("_hi"))))
    picked = hit.select("draw_id", F.col("_name").alias(dataset),
                        F.floor(uniform(f"mix-r-{seed}", F.col("draw_id")) * F.col("n")).cast("long").alias("_ri"))
    indexed = dense_index(df, [F.col(key)], group_cols=[dataset], out="_ri")
    return join_null_safe(picked, indexed, [dataset, "_ri"]).drop("_ri")


# H15 -----------------------------------------------------------------------------

def _passage(c) -> Column:
    return tx.compose_passage(c["title"], c["text"])


def pick_contrast(df: DataFrame, qid: str, n_neg: int, hard_ratio: float, hard_min: int = 0,
                  training: bool = True, seed: int = 0) -> DataFrame:
    """(query, gold, negatives[]) per example; missing lists are empty.

    Training: a random gold; n_hard = #(u_j < ratio, j < n_neg) capped by the
    hard negatives past ``hard_min``; the rest random negatives, capped.
    Eval: first gold, first negative."""
    kind = df.schema["hard_negative_ctxs"].dataType
    neg, hard = (F.coalesce(c, F.array().cast(kind)) for c in ("negative_ctxs", "hard_negative_ctxs"))
    pos = F.col("positive_ctxs")
    if not training:
        negs = F.when(F.size(neg) > 0, F.array(_passage(F.element_at(neg, 1)))).otherwise(F.array().cast("array<string>"))
        return df.select(qid, F.col("question").alias("query"), _passage(F.element_at(pos, 1)).alias("gold"),
                         negs.alias("negatives"))
    k = F.col(qid)
    g_idx = F.floor(uniform(f"gold-{seed}", k) * F.size(pos)).cast("int")
    draws = F.aggregate(F.sequence(F.lit(0), F.lit(n_neg - 1)), F.lit(0),
                        lambda a, j: a + F.when(uniform(f"hard-{seed}", k, j) < hard_ratio, 1).otherwise(0))
    hard_pool = F.slice(hard, hard_min + 1, F.greatest(F.size(hard) - hard_min, F.lit(0)))
    n_hard = F.least(draws, F.size(hard_pool))
    n_rand = F.least(F.lit(n_neg) - n_hard, F.size(neg))

    def sample(arr, n, tag):
        keyed = F.transform(arr, lambda c, i: F.struct(uniform(f"{tag}-{seed}", k, i).alias("h"), i.alias("i"),
                                                       _passage(c).alias("p")))
        return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["p"])

    x = df.select(qid, "question", F.element_at(pos, g_idx + 1).alias("_g"), n_hard.alias("n_hard"),
                  n_rand.alias("n_rand"), neg.alias("negative_ctxs"), hard_pool.alias("_hp"))
    negs = F.concat(sample(F.col("negative_ctxs"), F.col("n_rand"), "rneg"), sample(F.col("_hp"), F.col("n_hard"), "hneg"))
    return x.select(qid, F.col("question").alias("query"), _passage(F.col("_g")).alias("gold"),
                    negs.alias("negatives"), "n_hard", "n_rand")


# H16 -----------------------------------------------------------------------------

def union_samples(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
