"""Uniform shuffle into shards of exact sizes through a communication matrix.

Rows fall into blocks by a seeded hash. For every block the number of rows it
sends to each shard is drawn from the multivariate hypergeometric law (a block
is a sample without replacement of the shards' free places), so that the
matrix has the law it has under a uniform random permutation, and its column
sums are the exact shard sizes. Then: permute inside each block and cut the
order by the block's counts, exchange, permute again inside each shard.

Only counts reach the driver: one number per block of about ``rows_per_block``
rows. Rows move twice, without their texts.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import fresh, materialize

MIN_BLOCKS = 64
ROWS_PER_BLOCK = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of good + bad without replacement,
    by inversion outwards from the mode (double precision)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p_mode
    if u <= 0:
        return mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(block_rows: dict[int, int], n_shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each block sends to each shard. Rows sum to the blocks'
    sizes, columns to shard sizes that differ by one at most."""
    total = sum(block_rows.values())
    free = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = random.Random(seed)
    matrix = {}
    for b in sorted(block_rows):
        left, places, row = block_rows[b], sum(free), []
        for s in range(n_shards):
            places -= free[s]
            row.append(take := hypergeometric(rng, free[s], places, left))
            free[s] -= take
            left -= take
        matrix[b] = row
    return matrix


def shuffle_into_shards(df: DataFrame, key_cols: list[str], n_shards: int = 8, seed: int = 17,
                        min_blocks: int = MIN_BLOCKS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0
    in each shard).

    The same rows give the same result whatever the partitioning: all draws
    are hashes of (seed, ``key_cols``). Rows with equal keys are ordered by
    all their other columns; wholly equal rows are interchangeable. Null keys
    hash like any value. A key that many rows share does not gather: blocks
    are hashes of all columns. An empty table returns no rows.
    """
    spark = df.sparkSession
    names = {k: fresh(df.columns, k) for k in ("block_", "mix_", "bucket_", "at_", "cuts_", "base_", "n_")}
    block, mix, bucket, at, cuts, base, n = (names[k] for k in names)
    shard, slot = fresh(df.columns, "shard"), fresh(df.columns, "slot")
    ties = [F.col(c) for c in [*key_cols, *[c for c in df.columns if c not in key_cols]]]
    rows = materialize(df.withColumn(mix, F.xxhash64(F.lit(seed), *ties)))
    n_blocks = max(min_blocks, math.ceil(rows.count() / rows_per_block))
    tagged = rows.withColumn(block, F.pmod(F.xxhash64(F.lit(seed + 1), mix), F.lit(n_blocks)))
    sizes = {r[block]: r["count"] for r in tagged.groupBy(block).count().collect()}
    if not sizes:
        return df.withColumns({shard: F.lit(0), slot: F.lit(0).cast("bigint")}).where(F.lit(False))
    ends = [{"b": b, "c": [sum(row[: s + 1]) for s in range(n_shards)]}
            for b, row in communication_matrix(sizes, n_shards, seed).items()]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<b:bigint,c:array<bigint>>>"))
                                 ).select(F.col("b").alias(block), F.col("c").alias(cuts))
    # first permutation: inside the block; its order is cut by the block's counts
    local = Window.partitionBy(block).orderBy(mix, *ties)
    dealt = (tagged.withColumn(at, F.row_number().over(local) - 1).join(plan, block)
             .withColumn(shard, F.size(F.filter(F.col(cuts), lambda c: c <= F.col(at))).cast("int")))
    # exchange; second permutation: by a fresh hash, in buckets so that no task holds a whole shard
    again = F.xxhash64(F.lit(seed + 2), mix)
    dealt = materialize(dealt.select(*df.columns, shard, again.alias(mix),
                                     F.pmod(again, F.lit(max(1, n_blocks // n_shards))).alias(bucket)))
    before = Window.partitionBy(shard).orderBy(bucket)
    starts = (dealt.groupBy(shard, bucket).agg(F.count("*").alias(n))
              .select(shard, bucket, (F.sum(n).over(before) - F.col(n)).alias(base)))
    inside = Window.partitionBy(shard, bucket).orderBy(mix, *ties)
    return (dealt.withColumn(at, F.row_number().over(inside) - 1).join(starts, [shard, bucket])
            .select(*df.columns, shard, (F.col(base) + F.col(at)).cast("bigint").alias(slot)))
