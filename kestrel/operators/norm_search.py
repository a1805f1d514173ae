"""Exact inner-product top-k over blocks with bounds.

Vectors are written once in blocks of about equal norm: in order of their norm,
``BLOCK_ROWS`` together, with the largest norm, the centre and the radius of each
block. For a query q no vector of a block scores more than the smaller of
|q| · norm and q · centre + |q| · radius; a block whose bound is below the query's present
k-th score is skipped. A task begins with its longest vectors, so on norms that
differ most blocks are skipped; on unit vectors only what lies apart is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ordering import dense_index, top_k_per_group
from kestrel.operators.retrieval import SCORE_DIGITS, VECTOR_QUERY_BLOCK, VECTOR_ROWS, _pairs_of_equals, _RunningTopK
from kestrel.session import materialize

BLOCK_ROWS = 1_024
_BLOCKS = "dim int, norm double, centre array<double>, radius double, pids binary, vectors binary"


def _cut(block_rows: int):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def block(pids, m) -> pa.RecordBatch:
        centre = m.mean(0)
        radius = np.sqrt(((m - centre) ** 2).sum(1)).max()
        values = [[m.shape[1]], [np.sqrt((m * m).sum(1)).max()], [centre], [radius], [pids.tobytes()], [m.tobytes()]]
        kinds = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pids, rows = [], []
        for batch in batches:
            for pid, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows and (len(rows) == block_rows or len(vec) != len(rows[0])):
                    yield block(np.array(pids, np.int64), np.array(rows, float))
                    pids, rows = [], []
                pids.append(pid)
                rows.append(vec)
        if rows:
            yield block(np.array(pids, np.int64), np.array(rows, float))
    return run


def norm_blocks(corpus_vec: DataFrame, pid: str = "pid", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table of blocks. Null vectors are left out; vectors of
    another length lie in blocks of their own."""
    v = F.col("vec")
    rows = corpus_vec.select(F.col(pid).cast("long").alias("pid"), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    n = max(1, int(corpus_vec.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.withColumn("dim", F.size("vec")).withColumn("norm", norm)
    # long and short vectors in every task: a task meets high scores first, and its short blocks are the ones it skips
    dealt = ordered.repartition(n, F.xxhash64("pid")).sortWithinPartitions("dim", F.desc("norm"), "pid")
    return materialize(dealt.select("pid", "vec").mapInArrow(_cut(block_rows), _BLOCKS))


def _searched(sent, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        lengths = np.sqrt((q * q).sum(1))
        top = _RunningTopK(len(qids), k)
        met = skipped = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != q.shape[1]:
                    continue
                bound = np.minimum(lengths * row["norm"], q @ np.array(row["centre"]) + lengths * row["radius"])
                open_ = np.flatnonzero(bound + 1e-9 * (1 + np.abs(bound)) + 10.0 ** -SCORE_DIGITS >= top.kth)
                met, skipped = met + len(qids), skipped + len(qids) - len(open_)
                if not len(open_):
                    continue
                pids = np.frombuffer(row["pids"], np.int64)
                vectors = np.frombuffer(row["vectors"]).reshape(len(pids), -1)
                for at in range(0, len(pids), VECTOR_ROWS):
                    some = pids[at:at + VECTOR_ROWS]
                    scores = q[open_] @ vectors[at:at + VECTOR_ROWS].T
                    if exclude_self:
                        scores[_pairs_of_equals(qids[open_], some)] = -np.inf
                    top.add(scores, some, open_)
                top.compact()
        at, p, s = top.compact()
        yield pa.RecordBatch.from_arrays(
            [pa.array([*qids[at].tolist(), None], pa.int64()), pa.array([*p.tolist(), None], pa.int64()), pa.array([*s.tolist(), 0.0]),
             pa.array([0] * len(at) + [met], pa.int64()), pa.array([0] * len(at) + [skipped], pa.int64())], ["qid", "pid", "score", "met", "skipped"])
    return run


def bounded_topk(blocks: DataFrame, query_vec: DataFrame, k: int, exclude_self: bool = False, qid: str = "qid", vec: str = "embedding",
                 slab: int = VECTOR_QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((qid, pid, score, rank), (met, skipped)): the k best by score (9
    digits) and id, and how many pairs of query and block were met and skipped. A slab
    of ``slab`` queries is one job whose result is written and whose broadcast is released."""
    spark = blocks.sparkSession
    asked = query_vec.select(F.col(qid).cast("long").alias("qid"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    placed = materialize(dense_index(asked, ["qid"], out="n").withColumn("slab", F.floor(F.col("n") / slab)))
    last, found = placed.agg(F.max("slab")).first()[0], None
    for s in range(0 if last is None else last + 1):
        rows = placed.where(F.col("slab") == s).orderBy("n").select("qid", "v").collect()  # ``slab`` rows at most
        sent = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)))
        part = materialize(blocks.mapInArrow(_searched(sent, k, exclude_self), "qid long, pid long, score double, met long, skipped long"))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "qid long, pid long, score double, met long, skipped long")
    run = top_k_per_group(found.where("pid is not null").select("qid", "pid", "score"), ["qid"], [F.desc("score"), F.asc("pid")], k)
    return run, found.where("pid is null").agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped"))
