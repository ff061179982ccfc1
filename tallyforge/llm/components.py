"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (those that are larger, or the smaller ones and itself) joined to the smallest of its neighbourhood."""
    if larger:
        # Every edge in both directions; the node's own neighbourhood holds itself.
        near = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, any direction, repeats and loops allowed -> ``(node, component)``.

    The component is its smallest node. Every round joins each node's larger
    neighbours, then its smaller ones, to the smallest node it knows, which keeps
    the components and ends in stars after a number of rounds that grows with the
    logarithm of the nodes in practice. A round is one job: edges stay distributed,
    and only their number and the sum of their hashes reach the driver, to see that
    a round changed nothing. No edges: no rows.
    """
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        seen = Observation()
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
        left = checkpointed(_starred(_starred(left, True), False).observe(seen, F.count(F.lit(1)).alias("n"), mark))
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
    nodes = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(left.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
