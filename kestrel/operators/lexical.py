"""A stored lexical index: postings by term, with block maxima.

``build_index`` reads the corpus once. A task numbers its passages in shards of
at most ``SHARD_PASSAGES`` and turns each shard into postings where it stands (no
shuffle); the postings are then written in order of term and shard, with each
posting's impact tf / (tf + norm) and, for every cell of ``CELL`` passages,
the largest impact in it. Any number of queries is answered from these tables;
the corpus is not read again.

``search`` joins a slab of queries' terms with the postings, brings the rows of
a shard together (a bounded number of passages) and goes through the slab's
queries: the sum of weight times largest impact bounds what a passage of a
cell can score, and a cell whose bound is below the query's present k-th score is
skipped. The k-th scores run on over all shards of a task. The result is exact.

With ``analysis="english"`` stop words are dropped while postings are made, and
stems come in through the dictionary: the stemmer sees every distinct term
once, and postings of terms with one stem are merged by shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.functions.stem import STOP_WORDS, stem
from kestrel.operators.ordering import dense_index, top_k_per_group
from kestrel.session import materialize

SHARD_PASSAGES = 4_096
SHARD_TOKENS = 2_000_000
CELL = 64
SLAB = 2_048  # queries of one search job
DIGITS = 9

_RAW = "term string, shard long, slots array<int>, tfs array<int>, dls array<int>, pids array<long>"
_POSTINGS = "term string, shard long, slots array<int>, impacts array<double>, cells array<int>, tops array<double>"


@dataclass
class LexicalIndex:
    """``postings`` (see ``_POSTINGS``), ``terms`` (term, df), ``passages``
    (shard, pids) and what scores need of the corpus."""

    postings: DataFrame
    terms: DataFrame
    passages: DataFrame
    n_docs: int
    avgdl: float
    analysis: str


def _ints(x, kind=pa.int32()) -> pa.Array:
    return pa.array(np.asarray(x), type=kind)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(_ints(offsets), values)


def _inverted(shard: int, pids: pa.Array, tokens: pa.ListArray, stop: list[str]) -> Iterator[pa.RecordBatch]:
    """One shard's postings, and a row without a term for its passages."""
    lens = np.diff(tokens.offsets.to_numpy())
    slot = np.repeat(np.arange(len(lens)), lens)
    words = tokens.flatten().dictionary_encode()
    code, names = words.indices.to_numpy(), words.dictionary
    if stop:
        keep = ~pc.is_in(names, value_set=pa.array(stop)).to_numpy(zero_copy_only=False)[code]
        slot, code = slot[keep], code[keep]
        lens = np.bincount(slot, minlength=len(lens))
    n = max(len(lens), 1)
    key, tf = np.unique(code.astype(np.int64) * n + slot, return_counts=True)
    term, slots = key // n, key % n
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(first, len(term))
    none = pa.nulls(1, pa.list_(pa.int32()))
    names_, shards = ["term", "shard", "slots", "tfs", "dls", "pids"], pa.array([shard], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), shards, none, none, pa.array([lens.astype(np.int32)], pa.list_(pa.int32())),
                                      pa.ListArray.from_arrays(_ints([0, len(pids)]), pids)], names_)
    for at in range(0, len(first), 20_000):
        rows = first[at:at + 20_000]
        cut = ends[at:at + len(rows) + 1]
        lo, hi = cut[0], cut[-1]
        off = cut - lo
        yield pa.RecordBatch.from_arrays(
            [names.take(_ints(term[rows])), pa.array(np.full(len(rows), shard), pa.int64()), _lists(off, _ints(slots[lo:hi])),
             _lists(off, _ints(tf[lo:hi])), _lists(off, _ints(lens[slots[lo:hi]])), pa.nulls(len(rows), pa.list_(pa.int64()))], names_)


def _invert(stop: list[str], most: int, most_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, n, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            at, spent = 0, 0
            while at < batch.num_rows:
                # as many passages as fit, one at least
                fit = int(np.searchsorted(ends, spent + most_tokens - size, "right")) - at
                take = min(max(fit, 0 if held else 1), most - n, batch.num_rows - at)
                if take:
                    held.append(batch.slice(at, take))
                    at, n = at + take, n + take
                    size, spent = size + int(ends[at - 1]) - spent, int(ends[at - 1])
                if n == most or size >= most_tokens or not take:
                    yield from _flush(shard, held, stop)
                    shard, held, n, size = shard + 1, [], 0, 0
        if held:
            yield from _flush(shard, held, stop)
    return run


def _flush(shard: int, held: list[pa.RecordBatch], stop: list[str]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held).combine_chunks()
    pids, tokens = t.column(0).chunk(0), t.column(1).chunk(0)
    if tokens.null_count or tokens.offset:
        tokens = pa.array(tokens.to_pylist(), pa.list_(pa.string())).fill_null([]) if tokens.null_count else pa.concat_arrays([tokens])
    return _inverted(shard, pids, tokens, stop)


def _finish_apart(k1: float, b: float, avgdl: float):
    """As ``_finish`` where no (term, shard) comes twice: whole batches of
    rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                rows = batch.slice(at, 5_000)
                slots, tfs, dls = (rows.column(i).flatten().to_numpy() for i in (2, 3, 4))
                offsets = rows.column(2).offsets.to_numpy()
                offsets = offsets - offsets[0]
                impacts = tfs / (tfs + k1 * (1 - b + b * dls / avgdl))
                row, cell = np.repeat(np.arange(rows.num_rows), np.diff(offsets)), slots // CELL
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                tops = np.maximum.reduceat(impacts, first) if len(first) else impacts
                ends = np.searchsorted(row[first], np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), _lists(offsets, _ints(slots)), _lists(offsets, pa.array(impacts)),
                     _lists(ends, _ints(cell[first])), _lists(ends, pa.array(tops))], ["term", "shard", "slots", "impacts", "cells", "tops"])
    return run


def _finish(k1: float, b: float, avgdl: float):
    """Rows in order of (term, shard), merged where equal, to impacts and the
    largest impact of each cell."""
    def done(term, shard, rows):
        slots, tfs, dls = (np.concatenate([r[i] for r in rows]) for i in range(3))
        if len(rows) > 1:
            slots, where = np.unique(slots, return_inverse=True)
            tfs, dls = np.bincount(where, tfs), np.bincount(where, dls) / np.bincount(where)
        impacts = tfs / (tfs + k1 * (1 - b + b * dls / avgdl))
        cells, first = np.unique(slots // CELL, return_index=True)
        return {"term": term, "shard": shard, "slots": slots, "impacts": impacts, "cells": cells, "tops": np.maximum.reduceat(impacts, first)}

    schema = pa.schema([("term", pa.string()), ("shard", pa.int64()), ("slots", pa.list_(pa.int32())), ("impacts", pa.list_(pa.float64())),
                        ("cells", pa.list_(pa.int32())), ("tops", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, out, size = None, [], [], 0
        for batch in batches:
            values = [batch.column(i).flatten().to_numpy() for i in (2, 3, 4)]
            offsets = batch.column(2).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for i, (term, shard) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if place != (term, shard):
                    if place is not None:
                        out.append(done(*place, rows))
                        size += len(out[-1]["slots"])
                        if size > 200_000 or len(out) > 5_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                    place, rows = (term, shard), []
                rows.append([v[offsets[i]:offsets[i + 1]] for v in values])
        if place is not None:
            out.append(done(*place, rows))
        yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms in ``terms`` (one column)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(t) for t in batch.column(0).to_pylist()], pa.string())],
                                             ["term", "stem"])
    return terms.distinct().mapInArrow(run, "term string, stem string")


def build_index(corpus: DataFrame, path: str, pid: str = "pid", title: str | None = "title", text: str = "text",
                analysis: str = "plain", k1: float = 1.2, b: float = 0.75, shard_passages: int = SHARD_PASSAGES,
                shard_tokens: int = SHARD_TOKENS) -> LexicalIndex:
    """Write the index of ``corpus`` under ``path`` and open it. A null
    text is a passage without tokens; every row is a passage of its own."""
    if analysis not in ("plain", "english"):
        raise ValueError(f"no analysis {analysis!r}")
    spark = corpus.sparkSession
    passage = tx.compose_passage(title, text) if title else F.col(text)
    docs = corpus.select(F.col(pid).cast("long").alias("pid"), F.coalesce(
        tx.word_tokens(F.lower(passage), lower=False), F.array().cast("array<string>")).alias("toks"))
    stop = sorted(STOP_WORDS.split()) if analysis == "english" else []
    # written as it comes out of the task that numbered the passages
    raw = materialize(docs.mapInArrow(_invert(stop, shard_passages, shard_tokens), _RAW))
    shards = raw.where("term is null")
    size = shards.agg(F.sum(F.size("pids")).alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    n_docs = int(size["n"] or 0)
    avgdl = float(size["tokens"] or 0) / max(n_docs, 1)
    rows = raw.where("term is not null")
    if analysis == "english":
        rows = rows.join(_stems(rows.select("term")), "term").withColumn("term", F.col("stem")).drop("stem")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    finished = (rows.select("term", "shard", "slots", "tfs", "dls").repartitionByRange(n, "term", "shard").sortWithinPartitions("term", "shard")
                .mapInArrow((_finish_apart if analysis == "plain" else _finish)(k1, b, avgdl or 1.0), _POSTINGS))  # only stems meet in a shard
    finished.write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("slots")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    shards.select("shard", "pids").write.mode("overwrite").parquet(f"{path}/passages")
    meta = [(n_docs, avgdl, analysis, k1, b)]
    spark.createDataFrame(meta, "n_docs long, avgdl double, analysis string, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """ValueError if the passages that are there are not those that were
    counted when the index was written."""
    meta = spark.read.parquet(f"{path}/meta").first()
    passages = spark.read.parquet(f"{path}/passages")
    have = passages.agg(F.sum(F.size("pids"))).first()[0] or 0
    if have != meta["n_docs"]:
        raise ValueError(f"{have} passages of {meta['n_docs']} under {path}")
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), passages,
                        meta["n_docs"], meta["avgdl"], meta["analysis"])


def _query_terms(index: LexicalIndex, queries: DataFrame, qid: str, q: str, count_repeats: bool) -> DataFrame:
    """(qid, term, weight) of the terms that the index has."""
    words = queries.select(F.col(qid).cast("long").alias("qid"), F.explode(tx.word_tokens(F.lower(F.col(q)), lower=False)).alias("term"))
    if index.analysis == "english":
        words = words.where(~F.col("term").isin(*sorted(STOP_WORDS.split())))
        words = words.join(_stems(words.select("term")), "term").select("qid", F.col("stem").alias("term"))
    counted = words.groupBy("qid", "term").agg((F.count(F.lit(1)) if count_repeats else F.lit(1)).alias("qtf"))
    idf = F.log(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.join(index.terms, "term").select("qid", "term", (F.col("qtf") * idf).alias("weight"))


class _Slab:
    """A slab's queries by number, with the places of their terms in
    ``terms`` (sorted)."""

    def __init__(self, rows):
        self.terms = np.array(sorted(set(rows["term"])), dtype=object)
        rows = rows.sort_values(["qid", "term"])
        self.qids, start = np.unique(rows["qid"].to_numpy(np.int64), return_index=True)
        place = np.searchsorted(self.terms, rows["term"].to_numpy(object))
        self.places = np.split(place, start[1:])
        self.weights = np.split(rows["weight"].to_numpy(float), start[1:])


def _scored(sent, k: int):
    """Rows sorted by shard to each query's best k passages of the task, and
    rows without a passage that count cells met and skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = sent.value
        nq = len(slab.qids)
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(nq)]
        met, skipped = np.zeros(nq, np.int64), np.zeros(nq, np.int64)
        value_set = pa.array(slab.terms, pa.string())

        def through(pids, postings):
            cells = -(-len(pids) // CELL)
            at = np.full(len(slab.terms), -1)
            tops = np.zeros((len(postings), cells))
            for i, (place, _, _, c, t) in enumerate(postings):
                at[place] = i
                tops[i, c] = t
            for q in range(nq):
                here = at[slab.places[q]]
                have = here >= 0
                if not have.any():
                    continue
                here, weight = here[have], slab.weights[q][have]
                bound = weight @ tops[here]
                scores, ids = best[q]
                least = scores[-1] if len(scores) == k else 0.0
                alive = (bound > 0) & (bound + 10.0 ** -DIGITS >= least)
                met[q] += np.count_nonzero(bound)
                skipped[q] += np.count_nonzero(bound) - np.count_nonzero(alive)
                if not alive.any():
                    continue
                total, some = np.zeros(len(pids)), not alive[bound > 0].all()
                for i, w in zip(here, weight):
                    _, slots, impacts, _, _ = postings[i]
                    if some:
                        keep = alive[slots // CELL]
                        slots, impacts = slots[keep], impacts[keep]
                    total[slots] += w * impacts
                found = np.flatnonzero(total)
                s = np.round(total[found], DIGITS)
                if len(s) > k:
                    least = max(least, np.partition(s, len(s) - k)[len(s) - k])
                good = (s >= least) & (s > 0)
                s, p = np.concatenate([scores, s[good]]), np.concatenate([ids, pids[found[good]]])
                order = np.lexsort((p, -s))[:k]
                best[q] = s[order], p[order]

        now, pids, postings = None, None, []
        for batch in batches:
            place = pc.index_in(batch.column(1), value_set=value_set).to_pylist()
            shards = batch.column(0).to_pylist()
            lists = [batch.column(i) for i in range(2, 7)]
            flat = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets.to_numpy()[0]) for c in lists]
            for i, shard in enumerate(shards):
                if shard != now:
                    if postings:
                        through(pids, postings)
                    now, postings = shard, []
                row = [v[o[i]:o[i + 1]] for v, o in flat]
                if place[i] is None:
                    pids = row[4].copy()
                else:
                    postings.append((place[i], row[0].copy(), row[1].copy(), row[2].copy(), row[3].copy()))
        if postings:
            through(pids, postings)
        lens = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.repeat(slab.qids, lens), slab.qids])),
             pa.concat_arrays([pa.array(np.concatenate([p for _, p in best]) if nq else [], pa.int64()), pa.nulls(nq, pa.int64())]),
             pa.array(np.concatenate([*[s for s, _ in best], np.zeros(nq)])),
             pa.array(np.concatenate([np.zeros(sum(lens), np.int64), met])), pa.array(np.concatenate([np.zeros(sum(lens), np.int64), skipped]))],
            ["qid", "pid", "score", "met", "skipped"])
    return run


def search(index: LexicalIndex, queries: DataFrame, k: int = 40, qid: str = "qid", q: str = "q", count_repeats: bool = False,
           slab: int = SLAB) -> tuple[DataFrame, DataFrame]:
    """((qid, pid, score, rank), (qid, met, skipped)): each query's k best
    passages by score (9 digits) and id, ranks from 0, and how many cells of passages
    its terms met and how many of those were skipped by their bound.

    Per slab of ``slab`` queries: its terms and weights reach the driver and
    the tasks, the postings of its terms are shuffled by shard, and the result
    is written."""
    weights = _query_terms(index, queries, qid, q, count_repeats)
    numbers = dense_index(weights.select("qid").distinct(), ["qid"], out="n")
    numbered = materialize(weights.join(numbers, "qid").withColumn("slab", F.floor(F.col("n") / slab)))
    last = numbered.agg(F.max("slab")).first()[0]
    spark, out, counts = index.postings.sparkSession, None, None
    for s in range(0 if last is None else last + 1):
        mine = numbered.where(F.col("slab") == s)
        sent = spark.sparkContext.broadcast(_Slab(mine.select("qid", "term", "weight").toPandas()))
        nothing = F.lit(None)
        rows = index.postings.join(mine.select("term").distinct(), "term", "left_semi").select(
            "shard", "term", "slots", "impacts", "cells", "tops", F.array().cast("array<long>").alias("pids"))
        shards = index.passages.select("shard", nothing.cast("string").alias("term"), *[
            F.array().cast(t).alias(c) for c, t in (("slots", "array<int>"), ("impacts", "array<double>"), ("cells", "array<int>"),
                                                    ("tops", "array<double>"))], "pids")
        sorted_ = rows.unionByName(shards).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = materialize(sorted_.mapInArrow(_scored(sent, k), "qid long, pid long, score double, met long, skipped long"))
        run = top_k_per_group(found.where("pid is not null").select("qid", "pid", "score"), ["qid"], [F.desc("score"), F.asc("pid")], k)
        cells = found.where("pid is null").groupBy("qid").agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped"))
        out, counts = (run, cells) if out is None else (out.unionByName(run), counts.unionByName(cells))
        sent.unpersist()
    if out is None:
        return (spark.createDataFrame([], "qid long, pid long, score double, rank int"),
                spark.createDataFrame([], "qid long, met long, skipped long"))
    return out, counts
