"""Score-array and token-array column expressions (F1–F7, C3, D8–D11,
H11, H13, H17).

Everything is a built-in higher-order function on ``array`` columns, so it
runs per row inside the JVM with no Python round trip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(value, f) -> Column:
    """``f`` of ``value`` evaluated once per row: inside a lambda a plain
    column expression would be evaluated for every element."""
    return F.get(F.transform(F.array(_c(value)), f), F.lit(0))


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda a, x: a + x)


def to_double_array(arr) -> Column:
    return _c(arr).cast("array<double>")


# F1
def softmax(logits, temperature=1.0) -> Column:
    t = _lit(temperature).cast("double")
    shares = lambda e: bind(array_sum(e), lambda s: F.transform(e, lambda v: v / s))
    return bind(to_double_array(logits), lambda x: bind(F.array_max(x), lambda m: bind(
        F.transform(x, lambda v: F.exp((v - m) / t)), shares)))


def logsumexp(arr) -> Column:
    return bind(to_double_array(arr), lambda x: bind(
        F.array_max(x), lambda m: m + F.log(array_sum(F.transform(x, lambda v: F.exp(v - m))))))


# F2
def label_subset_prob(logits, label_ids: list[int], index: int = 1) -> Column:
    """Restrict logits to the given label ids, softmax, take ``index``."""
    x = to_double_array(logits)
    sub = F.array(*[F.element_at(x, i + 1) for i in label_ids])
    return F.element_at(softmax(sub), index + 1)


# F3
def argmax_class(vec) -> Column:
    """Index of the maximum, first index on ties."""
    v = _c(vec)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# F4
def positive_prob(probs, pos_index: int) -> Column:
    """Probability of the class the head calls "correct"; the index differs
    between heads (1 for the plain head, 0 for the soft/temperature head),
    so callers must pass it explicitly."""
    return F.element_at(_c(probs), pos_index + 1)


# F5
def fourier_features(t, K: int = 6, t_range: tuple[float, float] = (1.0, 2.0)) -> Column:
    """[sin(t·2^k·w) for k<K] + [cos(t·2^k·w) for k<K], w = 2π/(tmax-tmin)."""
    w = 2 * math.pi / (t_range[1] - t_range[0])
    tt = _c(t).cast("double")
    ks = F.sequence(F.lit(0), F.lit(K - 1))
    sins = F.transform(ks, lambda k: F.sin(tt * F.pow(F.lit(2.0), k) * F.lit(w)))
    coss = F.transform(ks, lambda k: F.cos(tt * F.pow(F.lit(2.0), k) * F.lit(w)))
    return F.concat(sins, coss)


# F6 (per position; the row reduction is calibration.divergence)
def kl(p, q) -> Column:
    """KL(p‖q) = Σ p·(ln p − ln q), with 0·ln 0 = 0."""
    return F.aggregate(
        F.zip_with(to_double_array(p), to_double_array(q),
                   lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(F.lit(0.0))),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def jsd(p, q) -> Column:
    m = F.zip_with(to_double_array(p), to_double_array(q), lambda a, b: (a + b) / 2)
    return (kl(p, m) + kl(q, m)) / 2


def divergence(p, ref, kind: str) -> Column:
    if kind == "reverse_kl":
        return kl(p, ref)
    if kind == "forward_kl":
        return kl(ref, p)
    if kind == "jsd":
        return jsd(p, ref)
    raise ValueError(f"unknown divergence {kind}")


# F7
def apply_temperature(logits, log_t) -> Column:
    lt = _lit(log_t).cast("double")
    return F.transform(to_double_array(logits), lambda v: v / F.exp(lt))


# C3
def l2_normalize(vec) -> Column:
    """v / ||v||; a zero vector gives null."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return bind(to_double_array(vec), lambda v: bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(to_double_array(a), to_double_array(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


# D8
def inversions(arr) -> Column:
    """Number of pairs i<j with a[i] > a[j]."""
    a = _c(arr)
    per = F.transform(a, lambda x, i: F.size(F.filter(F.slice(a, i + 2, F.size(a) + 1),
                                                        lambda y: y < x)))
    return F.aggregate(per, F.lit(0), lambda acc, v: acc + v)


# D9
def gold_topk_overlap(ranks, k: int) -> Column:
    """Share of the first k entries with value < k (divisor: slice length)."""
    head = F.slice(_c(ranks), 1, k)
    return F.size(F.filter(head, lambda x: x < k)) / F.size(head)


# D10
def depth_to_cover(ranks, k: int) -> Column:
    """1-based position of the last value < k; n when there is none."""
    a = _c(ranks)
    last = F.aggregate(F.transform(a, lambda x, i: F.when(x < k, i + 1).otherwise(0)),
                       F.lit(0), lambda acc, v: F.greatest(acc, v))
    return F.when(last > 0, last).otherwise(F.size(a))


# D11
def rank_by_score(scores) -> Column:
    """Positions ordered by score descending; ties by position."""
    s = to_double_array(scores)
    keyed = F.transform(s, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda z: z["i"])


# H11
def add_bos_eos(tokens, bos: int | None, eos: int | None) -> Column:
    t = _c(tokens)
    parts = []
    if bos is not None:
        parts.append(F.array(F.lit(bos)))
    parts.append(t)
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts) if len(parts) > 1 else t


# H13
IGNORE_LABEL = -100


def loss_labels(prompt_ids, target_ids) -> Column:
    """-100 on every prompt position, the target ids after it."""
    return F.concat(F.array_repeat(F.lit(IGNORE_LABEL), F.size(_c(prompt_ids))), _c(target_ids))


# H17
def truncate_tokens(tokens, max_len: int) -> Column:
    return F.slice(_c(tokens), 1, max_len)
