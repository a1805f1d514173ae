"""Global order without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
The helpers here compute exact positions and prefix sums in two levels:

1. ``repartitionByRange`` splits the total order into contiguous, balanced
   ranges (Spark samples the keys to pick the bounds); the range-tagged input
   is written once to the checkpoint folder so sampling, totals and windows
   do not re-evaluate it;
2. per-range totals — one small row per (group, range) — are turned into
   exclusive offsets with a window over that tiny table;
3. inside each range a window (partitioned by the range id) gives local
   positions / sums, and the offset is added back.

There is one plan for every size. Null group values form a group of their
own (offsets join null-safe). Order keys must be total (include a unique
tie-breaker) for positions to be deterministic, and so that a hot key can
still be split across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import join_null_safe, materialize


def _n_ranges(df: DataFrame, n_ranges: int | None) -> int:
    if n_ranges:
        return n_ranges
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_sums(df: DataFrame, order_cols: list, value_cols: list[str],
                group_cols: list[str] | None = None, prefix: str = "cum_",
                inclusive: bool = True, n_ranges: int | None = None) -> DataFrame:
    """Add ``prefix+v`` = running sum of each value column along the order
    (within each group). ``order_cols`` may be names or sort Columns
    (e.g. ``F.col('p').desc()``)."""
    group_cols = list(group_cols or [])
    n = _n_ranges(df, n_ranges)
    order = [_col(c) for c in order_cols]
    # written once: range sampling, range totals and the local windows all
    # read this table instead of re-evaluating the input three times
    ranged = materialize(df.repartitionByRange(n, *[F.col(g) for g in group_cols], *order)
                         .withColumn("_rng", F.spark_partition_id()))

    totals = ranged.groupBy(*group_cols, "_rng").agg(
        *[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    w_off = Window.partitionBy(*group_cols).orderBy("_rng")
    offsets = totals.select(
        *group_cols, "_rng",
        *[(F.sum(f"_tot_{v}").over(w_off) - F.col(f"_tot_{v}")).alias(f"_off_{v}")
          for v in value_cols])

    frame = (Window.partitionBy(*group_cols, "_rng").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_loc_{v}")
                                 for v in value_cols])
    out = join_null_safe(local, offsets, [*group_cols, "_rng"])
    out = out.select(*df.columns, *[(F.col(f"_off_{v}") + F.col(f"_loc_{v}")).alias(prefix + v)
                                    for v in value_cols])
    return out


def dense_index(df: DataFrame, order_cols: list, group_cols: list[str] | None = None,
                out: str = "idx", n_ranges: int | None = None) -> DataFrame:
    """0-based position of each row in the total order (within groups)."""
    one = "_one_"
    tmp = df.withColumn(one, F.lit(1).cast("long"))
    res = prefix_sums(tmp, order_cols, [one], group_cols, prefix="_cum",
                      inclusive=False, n_ranges=n_ranges)
    return res.withColumnRenamed("_cum" + one, out).drop(one)


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group, 0-based ``rank_col``.

    Written as ``row_number() <= k`` so Catalyst plans a partial
    ``WindowGroupLimit`` before the shuffle: each map task ships at most k
    rows per group, which also tames a hot group.
    """
    w = Window.partitionBy(*group_cols).orderBy(*[_col(c) for c in order_cols])
    return (df.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= k)
            .withColumn(rank_col, (F.col("_rn") - 1).cast("int"))
            .drop("_rn"))
