"""Attempts, confidence reranking and selection.

An attempt table is ``(qid, rank, …, c[, prob][, temperature])`` — one row
per question and retrieved context (and temperature). The reference walks
ranks recursively and drops questions as they stop; here every candidate
rank is a row and the stop rank is computed relationally, which gives the
same answer and plans as group aggregates (``max_by`` with an explicit
tie-break struct) — no per-group collection except the bounded top-k merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.operators.ordering import top_k_per_group


def explode_attempts(retrievals: DataFrame, template: str, depth: int | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """(qid, rank, pid, d, d_t, z_prompt [, keep…]) — one row per retrieved
    context (each row's own depth, optionally capped at ``depth``);
    rows with a null field are dropped like the reference's ``dropna``."""
    keep = list(keep or [])
    ex = retrievals.select("qid", "q", *keep, F.posexplode("contexts").alias("rank", "c"))
    if depth is not None:
        ex = ex.where(F.col("rank") < depth)
    out = ex.select(
        "qid", F.col("rank").cast("int").alias("rank"), F.col("c.id").alias("pid"), *keep,
        F.col("c.text").alias("d"), F.col("c.title").alias("d_t"),
        tx.render_template(template, [("<question>", F.col("q")), ("<title>", F.col("c.title")),
                                      ("<context>", F.col("c.text"))]).alias("z_prompt"))
    return out.na.drop("any")


def top1_context(retrievals: DataFrame) -> DataFrame:
    first = F.element_at("contexts", 1)
    return retrievals.select("qid", first["text"].alias("d"), first["title"].alias("d_t"), first["id"].alias("pid"))


def _best(attempts: DataFrame, order_fields: list, key: str = "qid") -> DataFrame:
    cols = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order_fields)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def select_best(attempts: DataFrame, by: str = "c", key: str = "qid") -> DataFrame:
    """Arg-max of ``by`` per question; the earliest rank wins ties."""
    return _best(attempts, [F.col(by), -F.col("rank")], key)


def select_best_class_prob(attempts: DataFrame, key: str = "qid") -> DataFrame:
    """Highest class first, then highest prob, then earliest rank."""
    return _best(attempts, [F.col("c"), F.col("prob"), -F.col("rank")], key)


def stop_ranks(attempts: DataFrame, threshold: float = 1.0, top_k: int = 20, key: str = "qid") -> DataFrame:
    """Attempts a threshold walk visits: ranks up to and including the first
    rank with prob ≥ threshold (all ranks < top_k when none)."""
    a = attempts.where(F.col("rank") < top_k)
    w = Window.partitionBy(key)
    stop = F.min(F.when(F.col("prob") >= threshold, F.col("rank"))).over(w)
    return (a.withColumn("_stop", stop)
            .where(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop")))
            .drop("_stop"))


def threshold_stop(attempts: DataFrame, threshold: float = 1.0, top_k: int = 20,
                   by: str = "c", key: str = "qid") -> DataFrame:
    return select_best(stop_ranks(attempts, threshold, top_k, key), by, key)


def multi_first_only(attempts: DataFrame, key: str = "qid") -> DataFrame:
    """Class-only mode scores rank 0 only."""
    return select_best(attempts.where(F.col("rank") == 0), "c", key)


def merge_best_k(attempts: DataFrame, k: int, template: str, start: str, end: str,
                 key: str = "qid") -> DataFrame:
    """Top-k attempts by c (desc, earlier rank first on ties); their context
    sections (text between ``start`` and ``end`` of each prompt) are joined
    by newlines into a new prompt; q comes from the best attempt."""
    top = top_k_per_group(attempts, [key], [F.col("c").desc(), F.col("rank").asc()], k, rank_col="_pos")
    sect = top.select(key, "_pos", "q", tx.extract_between("z_prompt", start, end).alias("_sec"))
    g = sect.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_sec"))).alias("_s"),
        F.min_by("q", "_pos").alias("q"))
    block = F.concat(F.lit("\n"), F.array_join(F.transform("_s", lambda s: s["_sec"]), "\n"))
    return g.select(key, "q", block.alias("context_block"),
                    tx.render_template(template, [("<question>", F.col("q")),
                                                  ("<title> - <context>", block)]).alias("z_prompt"))


def merge_and_rescore(attempts: DataFrame, k: int, template: str, start: str, end: str, temperatures: list[float], score,
                      key: str = "qid") -> DataFrame:
    """(key, q, z_prompt, c): each question's best ``k`` attempts merged into
    one prompt, and that prompt's confidence, the mean of its scores at every
    temperature. ``score(df)`` adds ``c`` to rows with a ``prompt`` (the merged prompt with a
    temperature line before ``end``); with ``score_stage`` a prompt is scored once."""
    merged = merge_best_k(attempts, k, template, start, end, key).drop("context_block").na.drop("any")
    at = merged.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    asked = at.withColumn("prompt", tx.inject_before("z_prompt", end, tx.temperature_line("temperature")))
    c = ensemble_mean(score(asked.select(key, "temperature", "prompt")), [key])
    return merged.join(c, key)


def ensemble_mean(attempts: DataFrame, keys: list[str] | None = None, value: str = "c") -> DataFrame:
    keys = list(keys or ["qid", "rank"])
    return attempts.groupBy(*keys).agg(F.avg(value).alias(value))


def ensemble_class_prob(attempts: DataFrame, probs: str = "probs", keys: list[str] | None = None) -> DataFrame:
    """Per temperature: class = arg-max, prob = max; then the mean of each."""
    keys = list(keys or ["qid", "rank"])
    cls = (F.array_position(F.col(probs), F.array_max(probs)) - 1).cast("double")
    return attempts.groupBy(*keys).agg(F.avg(cls).alias("c"), F.avg(F.array_max(probs)).alias("prob"))


def threshold_stop_waves(candidates: DataFrame, score, threshold: float = 1.0, top_k: int = 20,
                         by: str = "c", key: str = "qid") -> DataFrame:
    """Threshold stop when scoring is the costly step: score rank 0 for every
    question, then rank r only for questions still open (``left_anti`` on
    those whose prob reached the threshold). At most
    ``top_k`` waves; each wave's scores are written to the checkpoint folder
    so lineage stays one wave deep. ``score(df)`` adds ``c`` and ``prob``. A
    question leaves only once a prob reached the threshold: missing ranks and
    null probs keep it open. Same answer as ``threshold_stop`` over fully
    scored attempts."""
    from kestrel.session import materialize

    scored = None
    ranks = candidates.where(F.col("rank") < top_k).agg(F.max("rank")).first()[0]
    for r in range((-1 if ranks is None else ranks) + 1):
        wave = candidates.where(F.col("rank") == r)
        if scored is not None:
            finished = scored.where(F.col("prob") >= threshold).select(F.col(key).alias("_done"))
            wave = wave.join(finished, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
        s = materialize(score(wave))
        scored = s if scored is None else scored.unionByName(s)
    return select_best(score(candidates.where(F.lit(False))) if scored is None else scored, by, key)
