"""Exact top-k by inner product on a bit-sliced index.

Components become integers, floor(scale · x). The index holds blocks of rows;
in a block every component is an attribute, stored as bit slices: bitmap j of
an attribute has a bit for each row whose value (above the block's least) has
bit j. A query's scores come by bitmap arithmetic alone: a query component c
adds the attribute |c| times, that is, each of its slices once for each set
bit of |c|, at the sum of both places; a negative c adds the complement
(largest value - value) instead, so that everything is a sum of natural numbers. All
bitmaps of one place are added by carry-save adders (three bitmaps of a place
become one there and one a place higher) until each place has one: the slices
of the scores. The best rows are then picked from the most
significant slice downward: rows with the bit set if they fit in, else only
they remain candidates. What is left at the boundary has one score and goes by
id. Scores of the picked rows are computed from their integers.

The index is a written table, dealt by a hash of the rows; every block meets
every query, in slabs of ``SLAB`` queries that go to the tasks by broadcast
(a fixed number of rows). A task passes on a row only if it is among the best k
that the task has seen for the query, so a slab's result is at most k rows for each query
and task; each slab's best k are written before the next slab is dealt.

Nulls and the rest: rows with a null id, a null vector or one that holds null,
NaN or infinity take no part. Equal rows (id and vector) count once; rows that
share the query's id are its own and not its candidates, and an id with several
vectors is several rows. Vectors meet those of their own length only. An empty table gives no
rows; other columns are ignored. A score has to fit in 62 bits: a block and a query
whose bound is greater raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import drop_table, materialize
from kestrel.operators.ordering import dense_index

BLOCK_ROWS = 16_384
SLAB = 4_096
_SAFE = 1 << 62


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, q): distinct usable rows with floor(scale · component)."""
    out = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return out.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("q")).distinct()


def _slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (bit, word) of natural numbers, one word for 64 rows."""
    width = int(values.max(initial=0)).bit_length()
    pad = -len(values) % 64
    out = np.empty((width, (len(values) + pad) // 64), np.uint64)
    for j in range(width):
        bits = np.concatenate([(values >> j & 1).astype(np.uint8), np.zeros(pad, np.uint8)])
        out[j] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out, width


def _build(block_rows: int):
    """Rows of a task to blocks of one vector length."""
    def block(ids: np.ndarray, m: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        least = m.min(0, initial=np.iinfo(np.int64).max) if len(m) else np.zeros(m.shape[1], np.int64)
        made = [_slices(m[:, d] - least[d]) for d in range(m.shape[1])]
        return {"dim": m.shape[1], "ids": ids.tobytes(), "q": m.tobytes(), "least": least.tolist(), "widths": [w for _, w in made],
                "slices": b"".join(s.tobytes() for s, _ in made)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                rows = held.setdefault(int(dim), [[], [], 0])
                rows[0].append(part.column(0).to_numpy())
                rows[1].append(part.column(1).flatten().to_numpy().reshape(part.num_rows, dim))
                rows[2] += part.num_rows
                while rows[2] >= block_rows:
                    ids, m = np.concatenate(rows[0]), np.concatenate(rows[1])
                    yield pa.RecordBatch.from_pylist([block(ids[:block_rows], m[:block_rows])], _INDEX)
                    rows[:] = [[ids[block_rows:]], [m[block_rows:]], rows[2] - block_rows]
        for ids, m, n in held.values():
            if n:
                yield pa.RecordBatch.from_pylist([block(np.concatenate(ids), np.concatenate(m))], _INDEX)
    return run


_INDEX = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("q", pa.binary()), ("least", pa.list_(pa.int64())),
                    ("widths", pa.list_(pa.int32())), ("slices", pa.binary())])


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table of blocks of (vec_id, q). Rows are dealt by their
    hash, so no id or run of ids fills one task. A task holds one block of each
    vector length."""
    n = max(1, -(-vectors.count() // block_rows))
    return materialize(vectors.repartition(n, F.xxhash64("vec_id", "q")).mapInArrow(
        _build(block_rows), "dim int, ids binary, q binary, least array<bigint>, widths array<int>, slices binary"))


class Block:
    """One block of the index, read back."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.q = np.frombuffer(row["q"], np.int64).reshape(len(self.ids), self.dim)
        self.least, self.widths = row["least"], row["widths"]
        self.words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, self.words)
        self.attribute = np.repeat(np.arange(self.dim), self.widths)  # of each slice
        self.bit = np.concatenate([np.arange(w) for w in self.widths]) if self.dim else np.empty(0, np.int64)
        self.all = np.packbits(np.arange(self.words * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def score_slices(self, query: list[int]) -> list[np.ndarray]:
        """Slices, least significant first, of the scores above their least
        possible value."""
        if sum(abs(c) * ((1 << w) + abs(x)) for c, w, x in zip(query, self.widths, self.least)) >= _SAFE:
            raise OverflowError("a score does not fit in 62 bits")
        c = np.array(query, np.int64)[self.attribute]
        signed = self.slices ^ np.where(c < 0, ~np.uint64(0), np.uint64(0))[:, None]
        times = np.abs(c)
        stacks: dict[int, list[np.ndarray]] = {}  # the bitmaps to add at each place
        for b in range(int(times.max(initial=0)).bit_length()):
            used = np.flatnonzero(times >> b & 1)
            for place in np.unique(self.bit[used]):
                stacks.setdefault(b + int(place), []).append(signed[used[self.bit[used] == place]])
        out, place = [], 0
        while stacks:
            m = np.concatenate(stacks.pop(place, [np.zeros((1, self.words), np.uint64)]))
            while len(m) > 1:
                third = len(m) // 3
                if third:
                    x, y, z = m[:third], m[third:2 * third], m[2 * third:3 * third]
                    half = x ^ y
                    total, carry = np.concatenate([half ^ z, m[3 * third:]]), (x & y) | (half & z)
                else:
                    total, carry = m[:1] ^ m[1:], m[:1] & m[1:]
                stacks.setdefault(place + 1, []).append(carry)
                m = total
            out.append(m[0])
            place += 1
        return out

    def top(self, query_id: int, query: list[int], k: int) -> np.ndarray:
        """Places in the block of the k best rows, ids of its own excluded;
        rows of equal score by id."""
        left, right = np.searchsorted(self.ids, [query_id, query_id + 1])
        open_ = self.all
        if left < right:
            own = np.zeros(self.words * 64, np.uint8)
            own[left:right] = 1
            open_ = open_ & ~np.packbits(own, bitorder="little").view(np.uint64)
        taken, n_taken = np.zeros(self.words, np.uint64), 0
        for s in reversed(self.score_slices(query)):
            have = open_ & s
            n = n_taken + int(np.bitwise_count(have).sum())
            if n > k:
                open_ = have
            else:
                taken, n_taken = taken | have, n
                open_ = open_ & ~s
            if n == k:
                break
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        return np.concatenate([rows(taken), rows(open_)[:k - n_taken]])  # what is open has one score, ids ascend


def _searched(sent, k: int):
    """The best k rows of each query of a broadcast slab in a task's blocks:
    one task keeps k rows for each query, whatever the number of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for place, query_id, query in sent.value:
                    if len(query) == block.dim:
                        at = block.top(query_id, query, k)
                        scores = block.q[at] @ np.array(query, np.int64)
                        both = [*held.get(place, ()), *zip((-scores).tolist(), block.ids[at].tolist())]
                        held[place] = sorted(both)[:k]
        rows = [(place, query_id, i, -less) for place, query_id, _ in sent.value for less, i in held.get(place, ())]
        columns = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "query_id", "vec_id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, k: int, slab: int = SLAB) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the greatest inner
    product with each of ``queries`` (vec_id, q), ties to smaller ids."""
    spark = index.sparkSession
    asked = materialize(dense_index(queries, ["vec_id", "q"], out="place").withColumn("slab", F.floor(F.col("place") / slab)))
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    n = asked.agg(F.max("slab")).first()[0]
    out = None
    for i in range(0 if n is None else n + 1):
        rows = asked.where(F.col("slab") == i).orderBy("place").select("place", "vec_id", "q").collect()  # at most ``slab`` rows
        sent = spark.sparkContext.broadcast([(r["place"], r["vec_id"], r["q"]) for r in rows])
        found = index.mapInArrow(_searched(sent, k), "place bigint, query_id bigint, vec_id bigint, score bigint")
        done = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        sent.unpersist()
        out = done if out is None else out.unionByName(done)
    drop_table(asked)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return out.select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k best rows of ``df`` for each of its rows with ``is_query``
    (a condition on ``vec_id``)."""
    vectors = materialize(integer_vectors(df, id_col, vec_col, scale))
    index = build_index(vectors)
    out = search(index, vectors.where(is_query), k)
    drop_table(vectors)
    return out
