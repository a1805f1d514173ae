"""Fitted models (I1, I2) on Spark ML / distributed aggregates.

The reference trains small heads on one GPU; here the probe is a Spark ML
multinomial logistic regression (a linear probe — a stated simplification
of its MLP head) and temperature scaling is a guarded Newton search on 1/T
where every step is one aggregate over the data (only scalars reach the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import arrays as ar


def probe_features(features: str, temperature: str | None = None, fourier_k: int = 6,
                   t_range: tuple[float, float] = (1.0, 2.0)):
    """Feature column: the hidden vector, optionally followed by the sin/cos
    Fourier features of a temperature column (F5)."""
    f = F.col(features).cast("array<double>")
    if temperature is not None:
        f = F.concat(f, ar.fourier_features(temperature, fourier_k, t_range))
    return f


def fit_probe(df: DataFrame, features: str, label: str, weight: str | None = None,
              max_iter: int = 100, reg: float = 0.0, temperature: str | None = None, fourier_k: int = 6,
              hidden: list[int] | None = None, seed: int = 0, n_classes: int | None = None):
    """Multinomial logistic regression probe (2 or 11 classes). ``weight``
    takes class weights (G13) or soft-label row weights (H7). With ``hidden``
    (sizes of hidden layers, may be empty) a multilayer perceptron; if it has
    weights or ``label`` is an array of shares (soft targets), the one of ``probe``."""
    soft = df.schema[label].dataType.simpleString().startswith("array")
    if soft and hidden is None:
        raise ValueError("soft targets of a linear probe are weighted rows (soft_rows)")
    if hidden is not None and (weight or soft):
        from kestrel.operators.probe import fit_hidden_probe

        if n_classes is None:
            n_classes = int(df.select(F.max(F.size(label) if soft else F.col(label).cast("int") + 1)).first()[0])
        return fit_hidden_probe(df, probe_features(features, temperature, fourier_k), F.col(label), n_classes, hidden,
                                F.col(weight) if weight else None, reg, max_iter, seed=seed)
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_f", array_to_vector(probe_features(features, temperature, fourier_k))) \
        .withColumn("_y", F.col(label).cast("double"))
    if hidden is not None:
        sizes = x.select(F.max(F.size(probe_features(features, temperature, fourier_k))).alias("d"), (F.max("_y") + 1).alias("c")).first()
        layers = [int(sizes["d"]), *hidden, int(sizes["c"])]
        return MultilayerPerceptronClassifier(featuresCol="_f", labelCol="_y", layers=layers, maxIter=max_iter, seed=seed).fit(x)
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", family="multinomial",
                            maxIter=max_iter, regParam=reg)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(x)


def probe_predict(model, df: DataFrame, features: str, temperature: str | None = None,
                  fourier_k: int = 6) -> DataFrame:
    """Adds ``probs`` (array<double>, one entry per class) and ``pred``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from kestrel.operators.probe import HiddenProbe

    if isinstance(model, HiddenProbe):
        return model.predict(df, probe_features(features, temperature, fourier_k))
    x = df.withColumn("_f", array_to_vector(probe_features(features, temperature, fourier_k)))
    out = model.transform(x)
    return out.withColumn("probs", vector_to_array("probability")) \
        .withColumn("pred", F.col("prediction").cast("int")) \
        .drop("_f", "rawPrediction", "probability", "prediction")


def _nll_terms(df: DataFrame, logits: str, label: str, a: float):
    """Per-row NLL at scale a = 1/T and its first two derivatives in a."""
    z = F.col(logits).cast("array<double>")
    w = F.transform(z, lambda v: v * F.lit(a))
    lse = ar.logsumexp(w)
    p = ar.bind(lse, lambda top: F.transform(w, lambda v: F.exp(v - top)))
    ez = F.aggregate(F.zip_with(p, z, lambda pi, zi: pi * zi), F.lit(0.0).cast("double"), lambda s, v: s + v)
    ez2 = F.aggregate(F.zip_with(p, z, lambda pi, zi: pi * zi * zi), F.lit(0.0).cast("double"), lambda s, v: s + v)
    zy = F.element_at(z, F.col(label).cast("int") + 1)
    return df.select((lse - zy * F.lit(a)).alias("nll"), (ez - zy).alias("g"), (ez2 - ez * ez).alias("h"))


def nll_at(df: DataFrame, logits: str, label: str, temperature: float) -> float:
    return float(_nll_terms(df, logits, label, 1.0 / temperature).agg(F.avg("nll")).first()[0])


def fit_temperature(df: DataFrame, logits: str, label: str, tol: float = 1e-8,
                    max_iter: int = 60, least: float = 1e-6, most: float = 1e6) -> dict:
    """Scalar T minimising mean NLL of softmax(logits / T).

    The mean NLL is convex in a = 1/T. Its slope is bracketed from a = 1 by
    doubling or halving; inside the bracket Newton steps on a are taken where
    they stay in it, bisection otherwise. Each evaluation is one aggregate.
    ``converged`` is false if the minimum lies outside [least, most]."""
    def at(a: float):
        r = _nll_terms(df, logits, label, a).agg(F.avg("nll"), F.avg("g"), F.avg("h")).first()
        return tuple(float(x) for x in r)

    nll0, g, h = at(1.0)
    a, n, nll = 1.0, 1, nll0
    low, high = (1.0, None) if g < 0 else (None, 1.0)
    while (low is None or high is None) and g != 0 and least < a < most:
        a = a * 2 if high is None else a / 2
        nll, g, h = at(a)
        n += 1
        if g < 0:
            low = a
        else:
            high = a
    # (a slope that vanished with the curvature has run into the limits of doubles)
    converged = h > 1e-12 and (g == 0 or (low is not None and high is not None))
    if converged and g != 0:
        for _ in range(max_iter):
            step = a - g / h if h > 0 else low
            nxt = step if low < step < high else (low + high) / 2
            if abs(nxt - a) <= tol * a:
                break
            a = nxt
            nll, g, h = at(a)
            n += 1
            if g < 0:
                low = a
            else:
                high = a
    return {"temperature": 1 / a, "nll_before": nll0, "nll_after": nll, "iterations": n, "converged": converged}
