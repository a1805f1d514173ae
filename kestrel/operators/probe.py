"""A hidden-layer probe with row weights and soft targets.

The loss is the weighted mean cross-entropy between the targets (a class or a
distribution over classes) and the softmax of a ReLU network. Every evaluation
of loss and gradient is one job: the parameters go to the tasks, a task adds up
its rows block by block, and the sums meet in ever fewer tasks until a few
rows reach the driver. The driver holds parameters only and takes
limited-memory quasi-Newton steps with a backtracking line search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import drop_table, materialize

MEMORY = 10  # steps that the quasi-Newton direction remembers
FAN_IN = 16  # sums that one task adds up


def _shapes(layers: list[int]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(layers, layers[1:]) for s in ((a, b), (b,))]


def _unpacked(theta: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in _shapes(layers)])
    return [x.reshape(s) for x, s in zip(np.split(theta, cuts[:-1]), _shapes(layers))]


def _forward(parts: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of each layer, and log-probabilities."""
    inputs = []
    for i in range(0, len(parts), 2):
        inputs.append(x)
        x = x @ parts[i] + parts[i + 1]
        if i + 2 < len(parts):
            x = np.maximum(x, 0)
    x = x - x.max(1, keepdims=True)
    return inputs, x - np.log(np.exp(x).sum(1, keepdims=True))


def _loss_and_gradient(theta: np.ndarray, layers: list[int], x: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight, weighted loss and gradient of a block of rows, summed."""
    parts = _unpacked(theta, layers)
    inputs, logp = _forward(parts, x)
    back = (np.exp(logp) * t.sum(1, keepdims=True) - t) * w[:, None]
    grads: list[np.ndarray] = []
    for i in range(len(parts) - 2, -1, -2):
        a = inputs[i // 2]
        grads[:0] = [a.T @ back, back.sum(0)]
        if i:
            back = (back @ parts[i].T) * (a > 0)
    return np.concatenate([[w.sum(), -(w * (t * logp).sum(1)).sum()], *[g.ravel() for g in grads]])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class HiddenProbe:
    """``theta`` with the sizes of all layers; how the fit ended."""

    theta: np.ndarray
    layers: list[int]
    loss: float
    iterations: int
    converged: bool

    def predict(self, df: DataFrame, features: Column) -> DataFrame:
        """``df`` plus ``probs`` and ``pred`` (first class on ties)."""
        sent = df.sparkSession.sparkContext.broadcast((self.theta, self.layers))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            theta, layers = sent.value
            for batch in batches:
                n = batch.num_columns - 1
                x = _matrix(batch.column(n)) if batch.num_rows else np.empty((0, layers[0]))
                p = np.exp(_forward(_unpacked(theta, layers), x)[1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list(p), pa.list_(pa.float64())), pa.array(p.argmax(1), pa.int32())],
                                                 [*batch.schema.names[:n], "probs", "pred"])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
        return df.withColumn("_features", features).mapInArrow(run, ", ".join([*fields, "probs array<double>", "pred int"]))


class _Objective:
    """Weighted mean loss and its gradient over a written table."""

    def __init__(self, table: DataFrame, layers: list[int], reg: float):
        self.table, self.layers, self.reg, self.jobs = table, layers, reg, 0

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        sent = self.table.sparkSession.sparkContext.broadcast(theta)
        layers = self.layers

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = 0.0
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    b = batch.slice(at, 4096)
                    total = total + _loss_and_gradient(sent.value, layers, _matrix(b.column(0)), _matrix(b.column(1)), b.column(2).to_numpy())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], ["part", "sums"])

        sums = self.table.mapInArrow(blocks, "part long, sums binary")
        left = self.table.rdd.getNumPartitions()
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            sums = sums.repartition(left, F.floor(F.col("part") / FAN_IN)).mapInArrow(_added, "part long, sums binary")
        total = sum(np.frombuffer(r["sums"]) for r in sorted(sums.collect(), key=lambda r: r["part"]))
        sent.unpersist()
        self.jobs += 1
        weight = max(total[0], 1e-300)
        return total[1] / weight + self.reg / 2 * theta @ theta, total[2:] / weight + self.reg * theta


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = part // FAN_IN
            rows[at] = rows.get(at, 0.0) + np.frombuffer(sums)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()])], ["part", "sums"])


def _direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse curvature, as the remembered (step, change of
    gradient) tell it, times ``g``."""
    q, kept = g.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (y @ s)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept)):
        q += s * (a - (y @ q) / (y @ s))
    return -q


def fit_hidden_probe(df: DataFrame, features: Column, target: Column, n_classes: int, hidden: list[int], weight: Column | None = None,
                     reg: float = 0.0, max_iter: int = 100, tol: float = 1e-6, seed: int = 0) -> HiddenProbe:
    """Probe with the ``hidden`` layers' sizes. ``target`` is a class number
    or an array of ``n_classes`` shares. Rows with a null feature, target or weight are
    not used. ``converged``: the loss or the gradient stopped moving (relative
    ``tol``) before ``max_iter`` steps."""
    kind = df.select(target.alias("t")).schema["t"].dataType.simpleString()
    shares = target.cast("array<double>") if kind.startswith("array") else F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: (c == target.cast("int")).cast("double"))
    rows = df.select(features.cast("array<double>").alias("x"), F.when(target.isNotNull(), shares).alias("t"),
                     (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).na.drop("any")
    table = materialize(rows)
    one = table.select(F.size("x").alias("d")).first()
    if one is None:
        raise ValueError("no rows to fit on")
    layers = [one["d"], *hidden, n_classes]
    rng = np.random.default_rng(seed)
    theta = np.concatenate([(rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in _shapes(layers)])
    objective = _Objective(table, layers, reg)
    loss, g = objective(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    converged, n = False, 0
    while n < max_iter and not converged:
        n += 1
        d = _direction(g, steps)
        slope = g @ d
        if slope >= 0:
            steps, d, slope = [], -g, -(g @ g)
        size = 1.0 if steps else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        for _ in range(20):
            nxt, g_next = objective(theta + size * d)
            if nxt <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            converged = True  # no step lowers the loss
            break
        s, y = size * d, g_next - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        converged = abs(loss - nxt) <= tol * max(abs(loss), 1e-12) or np.abs(g_next).max() <= tol
        theta, loss, g = theta + s, nxt, g_next
    drop_table(table)
    return HiddenProbe(theta, layers, float(loss), n, bool(converged))
