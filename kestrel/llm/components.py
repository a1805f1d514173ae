"""Connected components of an edge list by large and small stars.

Alternating the two star operations keeps the components and turns every one
into a star around its smallest node; the number of rounds grows with the
logarithm of the diameter. Edges stay in Spark throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import drop_table, materialize


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node of its component. Null ends and loops are ignored."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", low)
        # each node to its smallest neighbour, and its other neighbours to that one
        nxt = small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        after = materialize(nxt.where("a <> b").distinct())
        new = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_table(now)
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
