"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words, and word beginnings of four and
five letters. The machine's score is
sigmoid(b + Σ w_i + Σ_{i<j} <v_i, v_j>) over the text's used terms: besides a
weight, every term has a vector, and the inner products add what two terms
mean together (an insult and the mention of a group, say), which a sum of
weights cannot. The pair sum costs O(terms · factors).

Which terms are used hangs on how many rows there are to learn from, not on a
fixed bound: ``TERMS_A_ROW`` for each row of the rarer class (``USED_TERMS`` at
most). Three quarters are those whose presence goes with the label most
(chi-square); one quarter are those that go with it most among the rows that hold
one of the ``SEEDS`` first terms, so that a term which says something only beside
another one has its place too, as the pairs need it.

The machine is fitted on a bounded sample of labelled rows (``FIT_ROWS`` of
each class, the first by a hash of the id, one text for each id). Counts are
taken by Spark; what reaches the driver is bounded: two counts for each bucket,
and the used terms of the sample (``FIT_ROWS`` · 2 rows of ``USED_TERMS`` numbers at
most, whatever the texts' length). Scoring maps over all rows with the model
(``BUCKETS`` places and ``USED_TERMS`` · (1 + ``FACTORS``) numbers) broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import drop_table, fresh, materialize

BUCKETS = 1 << 18
FACTORS = 8
FIT_ROWS = 4_000  # of each class
USED_TERMS = 3_000  # at most
TERMS_A_ROW = 2  # used terms for each row of the rarer class (fewest errors in cross-validation on rows that are not held out)
SEEDS = 32
EPOCHS = 15
THRESHOLD = 0.3
_word = re.compile(r"[^\W_]+")
_MEMORY = 150_000


def token_terms(token: str) -> list[int]:
    """Buckets of the terms of a lower-case token without white space."""
    return [crc32(x.encode()) % BUCKETS for w in _word.findall(token)
            for x in (f"w{w}", *(f"b{w[:k]}" for k in (4, 5) if len(w) >= k))]


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the terms of ``text``."""
    out: set[int] = set()
    for token in set((text or "").lower().split()):
        out.update(token_terms(token))
    return np.sort(np.fromiter(out, np.int64, len(out)))


def chi_square(with_, without, n1: float, n0: float):
    """Corrected chi-square of a term in ``with_`` of n1 rows of class 1 and
    ``without`` of n0 rows of class 0 (numbers or arrays)."""
    c, d = n1 - with_, n0 - without
    top = (n1 + n0) * np.maximum(np.abs(with_ * d - without * c) - (n1 + n0) / 2, 0) ** 2
    return top / np.maximum((with_ + without) * (c + d) * n1 * n0, 1)


def term_budget(n1: float, n0: float) -> int:
    return int(min(USED_TERMS, TERMS_A_ROW * min(n1, n0)))


def _first(buckets: np.ndarray, chi: np.ndarray, most: int) -> np.ndarray:
    """Buckets of the greatest positive chi-squares; ties to the smaller bucket."""
    order = np.lexsort((buckets, -chi))[:most]
    return buckets[order[chi[order] > 0]]


def used_terms(buckets: np.ndarray, with_: np.ndarray, without: np.ndarray, n1: float, n0: float, beside) -> np.ndarray:
    """The used buckets. ``beside(seeds, most)`` gives (buckets, chi-squares) of
    the terms that go with the label most in rows with one of ``seeds``."""
    budget = term_budget(n1, n0)
    ranked = _first(buckets, chi_square(with_, without, n1, n0), budget)
    pairs = _first(*beside(ranked[:SEEDS], budget), budget) if len(ranked) else ranked
    own = ranked[:budget - budget // 4]
    return np.concatenate([own, pairs[~np.isin(pairs, own)][:budget // 4]])


class FactorizationMachine:
    """Second-order machine; ``place`` maps buckets to used terms (-1: none)."""

    def __init__(self, bias: float, place: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.place, self.weights, self.factors = bias, place, weights, factors
        self._tokens: dict[str, tuple[int, ...]] = {}

    def raw(self, x: np.ndarray) -> float:
        """Log-odds for the used terms ``x``."""
        v = self.factors[x]
        s = v.sum(0)
        return float(self.bias + self.weights[x].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, buckets: np.ndarray) -> float:
        p = self.place[buckets]
        return _sigmoid(self.raw(p[p >= 0]))

    def score_text(self, text: str | None) -> float:
        """As ``score(terms(text))``; a bounded number of tokens is remembered."""
        known, out = self._tokens, set()
        if len(known) > _MEMORY:
            known.clear()
        for token in set((text or "").lower().split()):
            got = known.get(token)
            if got is None:
                got = known[token] = tuple(int(p) for b in token_terms(token) if (p := self.place[b]) >= 0)
            if got:
                out.update(got)
        return _sigmoid(self.raw(np.fromiter(sorted(out), np.int64, len(out))))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def fit(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2,
        pair_rate: float = 0.1, decay: float = 1e-3, seed: int = 7) -> FactorizationMachine:
    """Machine from rows of places in ``used``: AdaGrad over one row at a time
    in a seeded order. The bias begins at the log-odds of the labels, so that
    without rows nothing is toxic."""
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.1, (len(used), FACTORS))
    gw, gv, gb = np.full(len(used), 0.1), np.full((len(used), FACTORS), 0.1), 0.1
    m = FactorizationMachine(math.log((labels.sum() + 0.01) / (len(labels) - labels.sum() + 1)), place, w, v)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            d = _sigmoid(m.raw(x)) - labels[i]
            gb += d * d
            m.bias -= rate * d / math.sqrt(gb)
            vx = v[x]
            dw = d + decay * w[x]
            dv = d * (vx.sum(0) - vx) + decay * vx
            gw[x] += dw * dw
            w[x] -= rate * dw / np.sqrt(gw[x])
            gv[x] += dv * dv
            v[x] = vx - pair_rate * dv / np.sqrt(gv[x])
    return m


def is_held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(i, y, terms): the fit's rows, a written table."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~is_held_out(F.col("i")))
    marks = marks.groupBy("i").agg(F.max("y").alias("y"))
    # the first of each class by a limit: every task sends ``fit_rows`` ids at most, and texts of other rows never move
    first = [marks.where(F.col("y") == c).orderBy(F.xxhash64("i"), "i").limit(fit_rows) for c in (0, 1)]
    rows = (docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text")).where("text is not null")
            .join(F.broadcast(first[0].unionByName(first[1])), F.col("d") == F.col("i")).groupBy("i", "y").agg(F.min("text").alias("text")))
    id_type = rows.schema["i"].dataType.simpleString()

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([terms(one.column(2)[0].as_py())], pa.list_(pa.int64()))],
                                                 ["i", "y", "terms"])

    return materialize(rows.mapInArrow(buckets, f"i {id_type}, y int, terms array<bigint>"))


def _beside(rows: DataFrame):
    """``beside`` of ``used_terms``, counted by Spark."""
    def run(seeds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        held = rows.withColumn("s", F.explode(F.array_intersect("terms", F.array(*[F.lit(int(x)) for x in seeds]))))
        sizes = {r["s"]: (float(r["n1"]), float(r["n0"])) for r in held.groupBy("s").agg(
            F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()}  # a row for each seed
        both = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, F.array(F.lit(n[0]), F.lit(n[1])))])
        n1, n0 = both[F.col("s")][0], both[F.col("s")][1]
        a, b, c, d = F.col("a"), F.col("b"), n1 - F.col("a"), n0 - F.col("b")
        top = (n1 + n0) * F.pow(F.greatest(F.abs(a * d - b * c) - (n1 + n0) / 2, F.lit(0.0)), 2)
        chi = top / F.greatest((a + b) * (c + d) * n1 * n0, F.lit(1.0))
        counts = held.select("s", "y", F.explode("terms").alias("t")).groupBy("s", "t").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        best = counts.select("t", chi.alias("chi")).groupBy("t").agg(F.max("chi").alias("chi")).orderBy(F.desc("chi"), "t").limit(2 * most)
        got = best.toPandas()
        return got["t"].to_numpy(np.int64), got["chi"].to_numpy(float)
    return run


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """Machine fitted on at most ``fit_rows`` labelled rows of each class
    that are not held out. Rows without id, text or label are not used, of an id
    with several texts only the least; with no usable row of some class every
    score is that of the bias. Ids may be of any type."""
    rows = _sample(docs, labels, id_col, text_col, label_col, fit_rows)
    sizes = {r["y"]: float(r["count"]) for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0.0), sizes.get(0, 0.0)
    counts = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).toPandas()
    used = used_terms(*(counts[c].to_numpy(k) for c, k in (("t", np.int64), ("a", float), ("b", float))), n1, n0, _beside(rows))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [p[p >= 0].tobytes() for p in (shared.value[np.asarray(t.values, np.int64)] for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["i", "y", "x"])

    id_type = rows.schema["i"].dataType.simpleString()
    got = sorted(rows.mapInArrow(places, f"i {id_type}, y int, x binary").collect(), key=lambda r: (r.i, bytes(r.x)))
    shared.unpersist()
    drop_table(rows)
    return fit([np.frombuffer(r.x, np.int32) for r in got], np.array([r.y for r in got], float), used)


def score_texts(df: DataFrame, model: FactorizationMachine, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` plus the score (0 to 1) of ``text_col``.

    Null and empty texts have no terms and get the bias alone. Rows are scored
    one by one from their text only: equal texts score alike, ids, ties and
    repeated rows do not matter, an empty table gives an empty one, other
    columns stay (one named as ``out`` is told apart by underscores).
    """
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.place, model.weights, model.factors))
    name = fresh(df.columns, out)
    cols, k = df.columns, df.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorizationMachine(*shared.value)
        for batch in batches:
            scores = [m.score_text(t.as_py()) for t in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*cols, name])

    return df.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    model = fit_on_labels(docs, labels, id_col, text_col)
    name = fresh(docs.columns, "score")
    return score_texts(docs, model, text_col).where(F.col(name) < threshold).select(*docs.columns)
