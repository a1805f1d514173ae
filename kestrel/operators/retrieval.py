"""Retrieval operators.

Corpus: DataFrame ``(pid long, title string, text string)``.
Queries: DataFrame ``(qid long, q string)``.
Run / scores: long DataFrame ``(qid, pid, score, rank)``; the nested form is
``contexts: array<struct<id, title, text, score>>`` ordered by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import StorageLevel

from kestrel.functions import text as tx
from kestrel.functions.hashing import order_key
from kestrel.operators.ordering import dense_index, top_k_per_group
from kestrel.session import materialize, scratch_folder

# Queries of one pass over the corpus: only a block's terms or vectors reach
# the driver and the tasks, however many queries there are.
TERM_QUERY_BLOCK = 512
VECTOR_QUERY_BLOCK = 4_096
TERM_ROWS = 1_024  # passages whose terms a worker handles at once
VECTOR_ROWS = 512  # passages scored at once against a block of vectors
SCORE_DIGITS = 9

CONTEXT_TYPE = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))


def _query_blocks(queries: DataFrame, key: str, rows: int):
    """Blocks of about ``rows`` queries each, by a hash of the key."""
    n = max(1, -(-queries.count() // rows))
    for b in range(n):
        yield queries.where(F.coalesce(F.pmod(F.xxhash64(key), F.lit(n)) == b, F.lit(b == 0)))


class _RunningTopK:
    """The k best (score desc, pid asc) of each query over all batches of a
    partition. Candidates below a query's present k-th score are never kept;
    the rest are sorted only once enough have gathered."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.kth = k, np.full(n_queries, -np.inf)
        self.parts: list[tuple] = []
        self.n, self.room = 0, max(4 * n_queries * k, 100_000)

    def add(self, scores: np.ndarray, pids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """``scores``: queries × passages; -inf is no candidate. They count
        rounded, but only those that may be kept are rounded. ``queries`` are the
        numbers of the rows, if not all queries are there."""
        kth = self.kth if queries is None else self.kth[queries]
        near = scores >= np.where(np.isfinite(kth), kth - 10.0 ** -SCORE_DIGITS - 1e-12 * np.abs(kth), kth)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k)
        if len(many):  # these scores alone have k candidates: the k-th of them is a bound too
            part = scores[many]
            own = np.round(-np.partition(-part, self.k - 1, axis=1)[:, self.k - 1], SCORE_DIGITS)
            kth = kth.copy()
            kth[many] = np.fmax(kth[many], own)
            near[many] = part >= np.where(np.isfinite(kth[many]), kth[many] - 10.0 ** -SCORE_DIGITS - 1e-12 * np.abs(kth[many]), kth[many])[:, None]
        q, c = np.divmod(np.flatnonzero(near), scores.shape[1] or 1)
        s = np.round(scores[q, c], SCORE_DIGITS)
        good = (s >= kth[q]) & (s > -np.inf)
        q, c, s = q[good], c[good], s[good]
        self.parts.append((q if queries is None else queries[q], pids[c], s))
        self.n += len(q)
        if self.n > self.room:
            self.compact()

    def compact(self) -> tuple:
        q, p, s = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.kth[q[place == self.k - 1]] = s[place == self.k - 1]
        self.parts = [(q[keep], p[keep], s[keep])]
        self.n = int(keep.sum())
        return self.parts[0]


def _pairs_of_equals(qids: np.ndarray, pids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, passage) of equal ids, repeated ids included."""
    order = np.argsort(qids, kind="stable")
    sorted_ = qids[order]
    first, n = np.searchsorted(sorted_, pids), np.searchsorted(sorted_, pids, "right") - np.searchsorted(sorted_, pids)
    at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    return order[at], np.repeat(np.arange(len(pids)), n)


def _matrix(vectors) -> np.ndarray:
    """Rows of an Arrow batch's vectors."""
    lens = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (lens != lens[:1]).any():
        raise ValueError("a vector is null or of another length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


# ---------------------------------------------------------------------------
# C1 BM25
# ---------------------------------------------------------------------------

def query_terms(queries: DataFrame, qid: str = "qid", q: str = "q",
                count_repeats: bool = False) -> DataFrame:
    """(qid, term, qtf): lower-cased tokens of each query."""
    qt = (queries.select(F.col(qid).alias("qid"), F.explode(tx.word_tokens(q, lower=False)).alias("tok"))
          .select("qid", F.lower("tok").alias("term"))
          .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))
    if not count_repeats:
        qt = qt.withColumn("qtf", F.lit(1).cast("long"))
    return qt


def _postings_arrow_fn(doc_rows: bool):
    """Per Arrow batch of passages: (pid, dl, term, tf) by a hash group-by on
    (row, token) — a passage is one input row, so counting its terms needs
    no shuffle. Optionally one null-term row per passage carrying its
    length."""

    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for rb in batches:
            pids = rb.column(0)
            toks = rb.column(1)
            offsets = toks.offsets.to_numpy()
            lens = np.diff(offsets).astype(np.int32)
            flat = toks.flatten()
            d = np.repeat(np.arange(len(lens)), lens)
            t = pa.table({"d": pa.array(d, type=pa.int64()), "term": flat})
            g = t.group_by(["d", "term"]).aggregate([("term", "count")])
            gd = g.column("d").to_numpy()
            out = {"pid": pc.take(pids, pa.array(gd)), "dl": pa.array(lens[gd]),
                   "term": g.column("term"), "tf": g.column("term_count").cast(pa.int64())}
            res = pa.table(out)
            if doc_rows:
                extra = pa.table({"pid": pids, "dl": pa.array(lens), "term": pa.nulls(len(lens), pa.string()),
                                  "tf": pa.array(np.ones(len(lens), dtype=np.int64))})
                res = pa.concat_tables([res, extra])
            for b in res.to_batches():
                yield b

    return fn


def bm25_postings(corpus: DataFrame, vocab: DataFrame | None, pid: str = "pid",
                  title: str | None = "title", text: str = "text",
                  doc_rows: bool = False) -> DataFrame:
    """Postings ``(pid, dl, term, tf)``, optionally restricted to ``vocab``.

    Tokenising stays in the JVM (lower-cased text, one regex pass); term
    frequencies are counted per passage inside an Arrow ``mapInArrow`` —
    no shuffle, since a passage is one row. A vocabulary is applied by a join
    on the term, which Spark broadcasts or shuffles by its size (AQE splits
    hot terms). With ``doc_rows`` every passage also yields one
    ``term = null`` row carrying its length, so corpus statistics come out of
    the same pass.
    """
    spark = corpus.sparkSession
    passage = tx.compose_passage(title, text) if title else F.col(text)
    docs = corpus.select(F.col(pid).alias("pid"), tx.word_tokens(F.lower(passage), lower=False).alias("toks"))
    schema = "pid long, dl int, term string, tf long"
    if vocab is None:
        return docs.mapInArrow(_postings_arrow_fn(doc_rows), schema)
    allp = docs.mapInArrow(_postings_arrow_fn(doc_rows), schema)
    v = vocab.select("term").distinct()
    marks = v.withColumn("_hit", F.lit(True))
    return (allp.join(marks, "term", "left")
            .where(F.col("_hit").isNotNull() | (F.col("term").isNull() & F.lit(doc_rows))).drop("_hit"))


def _bm25(corpus: DataFrame, queries: DataFrame, k1: float, b: float, count_repeats: bool,
          pid: str, title: str | None, text: str, qid: str, q: str) -> tuple[DataFrame, DataFrame]:
    qt = query_terms(queries, qid, q, count_repeats)
    vocab = qt.select("term").distinct()
    # one tokenising pass feeds statistics, document frequencies and scoring
    postings = bm25_postings(corpus, vocab, pid, title, text, doc_rows=True).persist(StorageLevel.MEMORY_AND_DISK)
    stats = postings.where(F.col("term").isNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = float(stats["n"]), float(stats["avgdl"] or 0.0)
    terms = postings.where(F.col("term").isNotNull())
    idf = (terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
           .select("term", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
    w = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + norm)
    scores = (terms.join(idf, "term").join(qt, "term")
              .groupBy("qid", "pid").agg(F.sum(w).alias("score")))
    return scores, postings


def bm25_scores(corpus: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75,
                count_repeats: bool = False, pid: str = "pid", title: str | None = "title",
                text: str = "text", qid: str = "qid", q: str = "q") -> tuple[DataFrame, DataFrame]:
    """All positive BM25 scores ``(qid, pid, score)`` and the cached pruned
    postings behind them (``unpersist`` it when done).

    score = Σ_t qtf·ln(1 + (N − df + .5)/(df + .5)) · tf / (tf + k1·(1 − b + b·dl/avgdl))
    """
    return _bm25(corpus, queries, k1, b, count_repeats, pid, title, text, qid, q)



def bm25_doc_index(corpus: DataFrame, vocab, pid: str = "pid", title: str | None = "title",
                   text: str = "text") -> DataFrame:
    """(pid, dl, idx array<int>): passage length in tokens and the vocabulary
    index of each query-term occurrence (repeats kept).

    Tokenising and picking the vocabulary's tokens stay in the JVM; only these
    tokens go through an Arrow ``mapInArrow`` that maps them to vocabulary
    indices, so what a Python worker holds does not grow with the length of
    passages. One row in, one row out: no shuffle, and only small integer
    lists leave the pass.
    """
    spark = corpus.sparkSession
    passage = tx.compose_passage(title, text) if title else F.col(text)
    docs = corpus.select(F.col(pid).alias("pid"), tx.word_tokens(F.lower(passage), lower=False).alias("toks"))
    # ``vocab``: numpy array of terms, or an existing broadcast of one
    bv = vocab if hasattr(vocab, "value") else spark.sparkContext.broadcast(vocab)
    wanted = [str(t) for t in bv.value]
    # a passage without tokens (null text) has length 0
    docs = docs.select("pid", F.when(F.col("toks").isNull(), 0).otherwise(F.size("toks")).alias("dl"),
                       F.filter("toks", lambda t: t.isin(wanted)).alias("toks"))

    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        vocab_pa = pa.array(bv.value, type=pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, TERM_ROWS):
                rb = batch.slice(at, TERM_ROWS)
                toks = rb.column(2)
                offsets = toks.offsets.to_numpy()
                idx = pc.index_in(toks.flatten(), value_set=vocab_pa).cast(pa.int32())
                lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32), type=pa.int32()), idx)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), lists], names=["pid", "dl", "idx"])

    return docs.mapInArrow(fn, "pid long, dl int, idx array<int>")


def _bm25_block_fn(bstate, k: int, k1: float, b: float, avgdl: float, chunk: int):
    """Per partition: score passages chunk by chunk as a (passages × terms) @
    (terms × queries) product over the terms that the chunk has, and keep a
    running exact top-k per query (score rounded to 9 digits). Emits at most
    queries × k rows per partition."""

    def fn(batches):
        (ends, term_q, term_w), qids = bstate.value  # query weights by term, as a sparse matrix
        nq, V = len(qids), len(ends) - 1
        top = _RunningTopK(nq, k)
        for rb in batches:
            pids_all = rb.column(0).to_numpy().astype(np.int64)
            dl_all = rb.column(1).to_numpy().astype(np.float64)
            lst = rb.column(2)
            offsets = lst.offsets.to_numpy()
            flat = lst.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for s0 in range(0, len(pids_all), chunk):
                s1 = min(s0 + chunk, len(pids_all))
                lo, hi = offsets[s0], offsets[s1]
                if hi == lo:
                    continue
                lens = np.diff(offsets[s0:s1 + 1])
                j = flat[lo - offsets[0]:hi - offsets[0]]
                d = np.repeat(np.arange(s1 - s0), lens)
                uk, tf = np.unique(d * V + j, return_counts=True)
                dd, jj = uk // V, uk % V
                norm = k1 * (1 - b + b * dl_all[s0:s1][dd] / avgdl)
                uj, jinv = np.unique(jj, return_inverse=True)
                G = np.zeros((s1 - s0, len(uj)))
                G[dd, jinv] = tf / (tf + norm)
                n = ends[uj + 1] - ends[uj]
                at = np.arange(n.sum()) + np.repeat(ends[uj] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                W = np.zeros((len(uj), nq))
                W[np.repeat(np.arange(len(uj)), n), term_q[at]] = term_w[at]
                S = np.round(G @ W, SCORE_DIGITS).T  # queries × passages
                S[S <= 0] = -np.inf  # no shared term: not a candidate
                top.add(S, pids_all[s0:s1])
        q, p, sc = top.compact()
        if len(q):
            import pyarrow as pa
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(p), pa.array(sc)], names=["qid", "pid", "score"])

    return fn


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = 40, k1: float = 1.2, b: float = 0.75,
              count_repeats: bool = False, pid: str = "pid", title: str | None = "title",
              text: str = "text", qid: str = "qid", q: str = "q", chunk: int = 256,
              block: int = TERM_QUERY_BLOCK) -> DataFrame:
    """(qid, pid, score, rank) — top-k per query, score (rounded to 9 digits)
    desc then pid asc, in one pass over the corpus.

    More than ``block`` queries: the pass writes an index (``lexical``) in the
    checkpoint folder, and all queries are answered from that. Up to ``block`` queries
    need no index:

    1. its terms and weights reach the driver (bounded by the block);
    2. one pass over the corpus: JVM tokenising + Arrow vocabulary lookup,
       one cached row per passage ``(pid, dl, idx)``, no shuffle;
    3. corpus statistics and document frequencies from the cache (at most one
       row per term of the block reaches the driver);
    4. the block's sparse query weights are broadcast and an Arrow
       ``mapInArrow`` scores passages in chunks with a running exact top-k;
    5. a ``WindowGroupLimit`` top-k over the per-partition candidates, written
       to the checkpoint folder; the cache is released.
    """
    if queries.count() > block:
        from kestrel.operators import lexical

        folder = scratch_folder(corpus.sparkSession, "lexical-index")
        index = lexical.build_index(corpus, folder, pid, title, text, k1=k1, b=b)
        return lexical.search(index, queries, k, qid, q, count_repeats)[0]
    qtp = query_terms(queries, qid, q, count_repeats).toPandas()
    return _bm25_block(corpus, qtp, k, k1, b, pid, title, text, chunk)


def _bm25_block(corpus: DataFrame, qtp: pd.DataFrame, k: int, k1: float, b: float, pid: str, title: str | None,
                text: str, chunk: int) -> DataFrame:
    spark = corpus.sparkSession
    if qtp.empty:
        return spark.createDataFrame([], "qid long, pid long, score double, rank int")
    vocab_list = np.array(sorted(qtp["term"].unique()), dtype=object)
    qids = np.array(sorted(qtp["qid"].unique()), dtype=np.int64)
    bv = spark.sparkContext.broadcast(vocab_list)
    bstate = None
    doc_idx = bm25_doc_index(corpus, bv, pid, title, text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = doc_idx.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        n_docs, avgdl = float(st["n"]), float(st["avgdl"] or 0.0) or 1.0
        dfreq = (doc_idx.select(F.explode(F.array_distinct("idx")).alias("j"))
                 .groupBy("j").agg(F.count(F.lit(1)).alias("df")).toPandas())
        df_arr = np.zeros(len(vocab_list))
        df_arr[dfreq["j"].to_numpy()] = dfreq["df"].to_numpy()
        idf = np.where(df_arr > 0, np.log(1 + (n_docs - df_arr + 0.5) / (df_arr + 0.5)), 0.0)
        term = np.searchsorted(vocab_list, qtp["term"].to_numpy())
        query = np.searchsorted(qids, qtp["qid"].to_numpy())
        order = np.argsort(term, kind="stable")
        weight = (qtp["qtf"].to_numpy() * idf[term])[order]
        ends = np.searchsorted(term[order], np.arange(len(vocab_list) + 1))
        bstate = spark.sparkContext.broadcast(((ends, query[order], weight), qids))
        cand = doc_idx.mapInArrow(_bm25_block_fn(bstate, k, k1, b, avgdl, chunk), "qid long, pid long, score double")
        return materialize(top_k_per_group(cand, ["qid"], [F.col("score").desc(), F.col("pid").asc()], k))
    finally:
        # the result is a written table: cache and broadcasts can go
        doc_idx.unpersist()
        bv.destroy()
        if bstate is not None:
            bstate.destroy()


def rank_run(scores: DataFrame, k: int) -> DataFrame:
    """Top-k per query of a ``(qid, pid, score)`` table.

    Scores are rounded to 9 digits so float noise from the summation order
    cannot flip the order; ties go to the smaller pid.
    """
    rounded = scores.withColumn("score", F.round("score", SCORE_DIGITS)).where(F.col("score") > 0)
    return top_k_per_group(rounded, ["qid"], [F.col("score").desc(), F.col("pid").asc()], k)


# ---------------------------------------------------------------------------
# C2 dense exact inner-product top-k
# ---------------------------------------------------------------------------

def _best_of_vectors(bq, k: int, exclude_self: bool, rows):
    """Per partition: each batch of passages scored against the block's
    queries, running exact top-k per query. ``rows`` makes the matrix of a
    batch's second column."""

    def fn(batches):
        import pyarrow as pa

        qids, qmat = bq.value
        top = _RunningTopK(len(qids), k)
        for batch in batches:
            for s in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(s, VECTOR_ROWS)
                pids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sc = qmat @ rows(part.column(1)).T
                if exclude_self:
                    sc[_pairs_of_equals(qids, pids)] = -np.inf
                top.add(sc, pids)
        q, p, sc = top.compact()
        yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(p, pa.int64()), pa.array(sc, pa.float64())], ["qid", "pid", "score"])
    return fn


def dense_topk(corpus_vec: DataFrame, query_vec: DataFrame, k: int = 40,
               exclude_self: bool = False, pid: str = "pid", qid: str = "qid",
               vec: str = "embedding", block: int = VECTOR_QUERY_BLOCK) -> DataFrame:
    """Exact inner-product top-k.

    Queries go in blocks of about ``block`` rows, each broadcast once; the
    corpus streams through an Arrow ``mapInArrow`` that does a matmul per
    batch and keeps a running top-k per query and partition (never all
    query × passage pairs); a ``WindowGroupLimit`` window keeps the global
    top-k. One plan for every size."""
    spark = corpus_vec.sparkSession
    corpus = corpus_vec.select(F.col(pid).alias("pid"), F.col(vec).cast("array<double>").alias("vec"))
    queries = query_vec.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec"))
    schema = "qid long, pid long, score double"
    cand = None
    for part in _query_blocks(queries, "qid", block):
        pdf = part.toPandas()
        if pdf.empty:
            found = spark.createDataFrame([], schema)
        else:
            shared = spark.sparkContext.broadcast((pdf["qid"].to_numpy().astype(np.int64), np.stack(pdf["vec"].to_numpy()).astype(np.float64)))
            found = corpus.mapInArrow(_best_of_vectors(shared, k, exclude_self, _matrix), schema)
        cand = found if cand is None else cand.unionByName(found)
    return top_k_per_group(cand, ["qid"], [F.col("score").desc(), F.col("pid").asc()], k)


# ---------------------------------------------------------------------------
# C4 pooling
# ---------------------------------------------------------------------------

def pool_vectors(df: DataFrame, key: str, pos: str, vec: str, mask: str | None = None,
                 mode: str = "mean", dim: int | None = None) -> DataFrame:
    """Masked mean over positions (``mode='mean'``) or the first position
    (``mode='cls'``) per key → ``(key, pooled array<double>)``.

    The mean is one vector aggregate (partial aggregation map-side, no
    per-group collection of vectors, one expression whatever the number of
    dimensions)."""
    if mode == "cls":
        first = df.groupBy(key).agg(F.min_by(F.col(vec), F.col(pos)).alias("pooled"))
        return first.select(key, F.col("pooled").cast("array<double>").alias("pooled"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    src = (df if mask is None else df.where(F.col(mask) == 1)).where(F.col(vec).isNotNull())
    rows = src.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return rows.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias("pooled"))


# ---------------------------------------------------------------------------
# C6 / C7
# ---------------------------------------------------------------------------

def sample_corpus(corpus: DataFrame, n: int, seed: int = 0, pid: str = "pid") -> DataFrame:
    """Uniform sample of n passages (all when fewer): seeded hash order +
    limit, which Spark plans as TakeOrderedAndProject (per-task top-n)."""
    return corpus.orderBy(order_key(seed, F.col(pid)), F.col(pid)).limit(n)


def assign_ids(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """Dense 0-based positional id in ``key`` order, keeping the source key."""
    return dense_index(df, [F.col(key)], out=out)


# ---------------------------------------------------------------------------
# C8 / C9
# ---------------------------------------------------------------------------

def assemble_contexts(run: DataFrame, corpus: DataFrame, pid: str = "pid",
                      title: str = "title", text: str = "text") -> DataFrame:
    """(qid, contexts) with contexts ordered by rank.

    The run (queries × k rows) is joined with the corpus; Spark broadcasts or
    shuffles it by its size.
    """
    docs = corpus.select(F.col(pid).alias("pid"), F.col(title).alias("title"), F.col(text).alias("text"))
    r = run.select("qid", "pid", "score", "rank")
    joined = docs.join(r, "pid")
    nested = joined.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "pid", "title", "text", "score"))).alias("_c"))
    return nested.select("qid", F.transform("_c", lambda c: F.struct(
        c["pid"].alias("id"), c["title"].alias("title"), c["text"].alias("text"),
        c["score"].alias("score"))).alias("contexts"))


def distinct_passages(retrievals: DataFrame) -> DataFrame:
    """Unique passage texts over all contexts; the title of the last
    occurrence (largest (qid, rank)) wins."""
    ex = retrievals.select("qid", F.posexplode("contexts").alias("rank", "c"))
    return ex.groupBy(F.col("c.text").alias("text")).agg(
        F.max_by(F.col("c.title"), F.struct("qid", "rank")).alias("title"),
        F.count(F.lit(1)).alias("n_refs"))


# ---------------------------------------------------------------------------
# C5 product-quantised search
# ---------------------------------------------------------------------------

def pq_train(corpus_vec: DataFrame, m: int, nbits: int, vec: str = "embedding", seed: int = 0,
             max_iter: int = 20) -> np.ndarray:
    """One Spark ML k-means (k = 2^nbits) per sub-vector; returns the
    codebooks, shape (m, 2^nbits, dim/m) — bounded model metadata."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dim = int(corpus_vec.select(F.size(vec)).first()[0])
    if dim % m:
        raise ValueError("dimension must be divisible by m")
    dsub = dim // m
    books = []
    for s in range(m):
        sub = corpus_vec.select(array_to_vector(F.slice(F.col(vec).cast("array<double>"), s * dsub + 1, dsub)).alias("features"))
        model = KMeans(k=2 ** nbits, seed=seed, maxIter=max_iter, featuresCol="features").fit(sub)
        centers = np.array([np.asarray(c) for c in model.clusterCenters()])
        if len(centers) < 2 ** nbits:  # fewer distinct points than centroids
            centers = np.vstack([centers, np.repeat(centers[-1:], 2 ** nbits - len(centers), axis=0)])
        books.append(centers)
    return np.stack(books)


def pq_encode(corpus_vec: DataFrame, books: np.ndarray, pid: str = "pid", vec: str = "embedding") -> DataFrame:
    """(pid, codes array<int>): nearest centroid per sub-vector."""
    bb = corpus_vec.sparkSession.sparkContext.broadcast(books)

    def fn(batches):
        B = bb.value
        m, K, dsub = B.shape
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            codes = np.empty((len(X), m), dtype=np.int32)
            for s in range(m):
                sub = X[:, s * dsub:(s + 1) * dsub]
                d2 = (sub ** 2).sum(1)[:, None] - 2 * sub @ B[s].T + (B[s] ** 2).sum(1)[None, :]
                codes[:, s] = d2.argmin(1)
            yield pd.DataFrame({"pid": pdf["pid"].to_numpy(), "codes": list(codes)})

    src = corpus_vec.select(F.col(pid).alias("pid"), F.col(vec).cast("array<double>").alias("vec"))
    return src.mapInPandas(fn, "pid long, codes array<int>")


def _decoded(books: np.ndarray):
    """Codes of a batch to the centroids they stand for, side by side."""
    def rows(codes) -> np.ndarray:
        c = _matrix(codes).astype(np.int64)
        return np.concatenate([books[i][c[:, i]] for i in range(len(books))], axis=1)
    return rows


def pq_topk(codes: DataFrame, books: np.ndarray, query_vec: DataFrame, k: int = 10,
            qid: str = "qid", vec: str = "embedding", block: int = VECTOR_QUERY_BLOCK) -> DataFrame:
    """Approximate inner-product top-k: a passage scores the sum, over its
    codes, of the products of the query's parts and the codes' centroids. That
    sum is the product of the query and the centroids side by side, so a batch
    of codes is decoded by its books and scored by one matrix product. Running
    top-k per query and partition, global WindowGroupLimit. Queries go in blocks
    of about ``block`` rows, so a broadcast never grows with the query set."""
    spark = codes.sparkSession
    queries = query_vec.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec"))
    schema = "qid long, pid long, score double"
    passages = materialize(codes.select("pid", "codes"))  # read for every block of queries, encoded once
    cand = None
    for part in _query_blocks(queries, "qid", block):
        pdf = part.toPandas()
        if pdf.empty:
            found = spark.createDataFrame([], schema)
        else:
            own = np.stack(pdf["vec"].to_numpy()).astype(np.float64)[:, :books.shape[0] * books.shape[2]]
            shared = spark.sparkContext.broadcast((pdf["qid"].to_numpy().astype(np.int64), own))
            found = passages.mapInArrow(_best_of_vectors(shared, k, False, _decoded(books)), schema)
        cand = found if cand is None else cand.unionByName(found)
    return top_k_per_group(cand, ["qid"], [F.col("score").desc(), F.col("pid").asc()], k)
