"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is a join or a map-side combined aggregation over edges; nothing is broadcast, and nothing collected but one
count and checksum a round. The smallest neighbour of each node is checkpointed before the join, so both join sides are
plain shuffles and adaptive execution can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffled


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut(out.where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(shuffled(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut(moved.union(least.select("a", F.col("m").alias("b"))).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b), the smallest node that it reaches.

    a and b have one orderable type. Edges with a null end and loops between a node and itself are left out (a node
    with loops only has no row); repeated edges count once; an empty table gives an empty one. It takes about
    log2 of the longest chain rounds.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = _small_star(_large_star(edges))
        state, before = _state(edges), state
        if state == before:
            break
    top = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top)
