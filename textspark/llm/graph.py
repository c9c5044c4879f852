"""Distributed connected components, in DataFrame operations only.

Alternating stars: each round links every node to the smallest neighbour
(large star), then every node's smaller neighbours to the smallest of them
(small star), until the edges are stars around the smallest nodes.  Rounds grow with the logarithm of the
size of a component.  Neighbourhoods are never gathered: a round takes minima
(combined before the shuffle), writes them, and joins them back to the edges.
Both sides of such a join are written tables, so a small one is broadcast by its
known size and a node with very many edges is split by adaptive execution.  Each
step is a table in the shared checkpoint folder, so a lost executor costs a step
at most; tables of earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut

ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per_node.where("out > 1 OR (out > 0 AND into > 0)").limit(1).count()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) for every node of an edge.

    Null ends and loops are left out, repeated edges count once, and an empty
    table of edges has no components.  Nodes may be of any ordered type.
    """
    pair = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(ROUNDS):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), least)
        # every row now goes from a node to a smaller one
        smallest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), now, large, smallest)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
