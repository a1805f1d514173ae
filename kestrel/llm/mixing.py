"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of levels (domain → language → source).
Siblings share their parent's budget by weight; a child whose tokens (times
the epochs allowed) fall short takes what it has, and the rest goes to its
siblings by weight before any of it is missing at their parent, whose own
siblings then take it over. That is water filling at every level, which
sorting the children by capacity per weight solves in closed form with two
running sums. All of it is integer arithmetic.

Each leaf then takes whole epochs and a token-prefix of the next one in a
seeded order. The prefix is found as a cutoff key: token sums of 4,096 hash
buckets locate the bucket where the quota ends, and only that bucket's rows
are put in order. Texts are filtered by the cutoff and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import fresh, materialize, words_of

DEFAULT_WEIGHT = 1


def _weight(c: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(DEFAULT_WEIGHT).cast("bigint")
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.coalesce(c, F.lit(""))), F.lit(DEFAULT_WEIGHT)).cast("bigint")


def water_fill(df: DataFrame, parents: list[str], child: str, weight: str, capacity: str, budget: str,
               out: str) -> DataFrame:
    """Add ``out``: each child's share of its parents' ``budget``, at most its
    ``capacity``. Children are taken by capacity per weight; once one is not
    filled up by an even share, it and all later ones share evenly (rounded
    down)."""
    by = parents or [F.lit(0)]
    order = [F.col(capacity) / F.col(weight), F.col(child)]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rest = F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))
    heavy = F.sum(weight).over(after)
    df = df.withColumn("rest_", F.greatest(rest, F.lit(0))).withColumn("heavy_", heavy)
    # the first child that its even share does not fill fixes the level for the rest
    open_ = F.col("rest_") * F.col(weight) < F.col(capacity) * F.col("heavy_")
    first = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("level_", F.min(F.when(open_, F.struct(order[0].alias("o"), F.col(child).alias("c"),
                                                               F.col("rest_").alias("r"), F.col("heavy_").alias("h")))).over(first))
    share = F.expr(f"level_.r * {weight} div level_.h").cast("bigint")
    filled = F.col("level_").isNull() | (F.struct(order[0].alias("o"), F.col(child).alias("c"))
                                         < F.struct(F.col("level_.o").alias("o"), F.col("level_.c").alias("c")))
    return df.withColumn(out, F.when(filled, F.col(capacity)).otherwise(F.least(share, F.col(capacity)))
                         ).drop("rest_", "heavy_", "level_")


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget_percent: int,
                max_epochs: int) -> DataFrame:
    """Quota of every leaf: ``leaves`` (levels, tokens) plus ``quota``."""
    one = leaves.withColumn("cap_", F.col("tokens") * max_epochs)
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_percent // 100
    parents: list[str] = []
    given = None
    for level in levels:
        nodes = one.groupBy(*parents, level).agg(F.sum("cap_").alias("cap_"))
        nodes = nodes.withColumn("weight_", _weight(F.col(level), weights.get(level, {})))
        nodes = nodes.withColumn("budget_", F.lit(total).cast("bigint")) if given is None else nodes.join(given, parents)
        filled = water_fill(nodes, parents, level, "weight_", "cap_", "budget_", "share_")
        parents = [*parents, level]
        given = filled.select(*parents, F.col("share_").alias("budget_"))
    return one.join(given, levels).select(*levels, "tokens", F.col("budget_").alias("quota"))


def select_mix(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]] | None = None,
               budget_percent: int = 100, max_epochs: int = 4, seed: int = 11, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``df`` plus ``n_tokens`` (white-space words) and ``copies`` (how often
    the mix takes the row, 0 if not).

    ``levels`` names a column for each level from the root down; ``weights[level]`` maps a
    level's values to integer weights of 1 or more (unlisted: 1). The budget
    is ``budget_percent`` of all tokens; no leaf gives more than
    ``max_epochs`` times its tokens. A row is in the prefix while the tokens
    before it in the seeded order stay below the quota.

    Null level values count as "" (one more sibling); null and empty texts
    have no tokens and are taken only by whole epochs; rows equal in id and
    text share a place in the order and are taken together; an empty table
    returns no rows; extra columns are kept (``n_tokens`` and ``copies`` get
    underscores in front if the table has them).
    """
    weights = weights or {}
    names = [f"level{i}_" for i in range(len(levels))]
    by_name = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    tokens, copies = fresh(df.columns, "n_tokens"), fresh(df.columns, "copies")
    own = [fresh(df.columns, n) for n in [*names, "fp_"]]
    level_cols = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels.values(), own)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    fp = F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    full = df.select("*", *level_cols, F.size(words_of(F.col(text_col))).cast("bigint").alias(tokens), fp.alias(own[-1]))
    small = materialize(full.select(*[F.col(a).alias(b) for a, b in zip(own, [*names, "fp"])],
                                    F.col(tokens).alias("n")))
    leaves = small.groupBy(*names).agg(F.sum("n").alias("tokens"))
    quotas = materialize(leaf_quotas(leaves, names, by_name, budget_percent, max_epochs))
    plan = quotas.select(*names, F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("int").alias("epochs"),
                         F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)).alias("rest"))
    keyed = small.join(plan, names).where("rest > 0").withColumn("key", _order_key(seed, F.col("epochs"), F.col("fp")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*names, "bucket", "rest").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (sums.withColumn("base", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
            .where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("n") >= F.col("rest")))
            .select(*names, "bucket", "base"))
    inside = Window.partitionBy(*names).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (keyed.join(ends, [*names, "bucket"]).groupBy(*names, "rest", "base", "key").agg(F.sum("n").alias("n"))
           .withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
           .where(F.col("before") < F.col("rest")).groupBy(*names).agg(F.max("key").alias("cut")))
    plan = materialize(plan.join(cut, names, "left").select(
        *[F.col(a).alias(f"{b}q") for a, b in zip(names, own)], F.col("epochs").alias("epochs_q"), F.col("cut").alias("cut_q")))
    hit = [F.col(a) == F.col(f"{a}q") for a in own[:-1]]
    in_prefix = _order_key(seed, F.col("epochs_q"), F.col(own[-1])) <= F.col("cut_q")
    return (full.join(plan, hit)
            .select(*df.columns, tokens, (F.col("epochs_q") + F.coalesce(in_prefix, F.lit(False)).cast("int")).alias(copies)))


def _order_key(seed: int, epoch: Column, fp: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), fp))


def repeat_copies(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says, without that column."""
    rest = [c for c in df.columns if c != copies]
    return df.where(F.col(copies) > 0).select(*rest, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("epoch_")).select(*rest)
