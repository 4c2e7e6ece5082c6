"""Connected components of a graph too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise

ROUNDS = 60
#: Most edges whose nodes' smallest neighbours, at most two an edge, are broadcast.
BROADCAST_EDGES = 400_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One step: every node ties its larger neighbours (large star), or its smaller ones and itself (small star), to the smallest.

    n: no fewer than the edges there are. Smallest neighbours too many to broadcast are written first, so that both sides of the join are plain
    exchanges and Spark can split the one of a node with very many neighbours.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    low = F.broadcast(low) if n <= BROADCAST_EDGES else materialise(low)
    tied = near.join(low, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of all nodes that an edge (a, b) of longs names with a <> b."""
    now = materialise(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = materialise(_star(_star(now, True, state[0]), False, 2 * state[0]))
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
