"""Connected components by alternating large and small stars.

Every round replaces each node's edges by edges to the smallest node near it. Minima are
aggregated before the shuffle and come back by a plain join, so adaptive execution can
split a hub that holds many of the edges. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _starred(near: DataFrame) -> DataFrame:
    """near (u, v) with m, the least of u and all v of u."""
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return near.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    large = _starred(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    small = _starred(large)
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u, so that each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count()


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), which are longs.

    Loops, repeats and rows with nulls count for nothing, except that a loop's node is a
    component. No edges give no rows. Rounds grow with the logarithm of the graph.
    """
    edges = storage.save(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = storage.save(_both(edges).select(F.col("u").alias("node")).distinct(), "nodes")
    now = storage.save(edges.where("u > v"), "stars")
    storage.drop(edges)
    for _ in range(rounds):
        if _settled(now):
            break
        after = storage.save(_round(now), "stars")
        storage.drop(now)
        now = after
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
