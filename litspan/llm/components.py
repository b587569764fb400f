"""Distributed connected components by alternating large-star and small-star steps.

The graph stays a DataFrame of edges from a node to a smaller one. A large-star step links each node's larger
neighbours to the smallest one around it, a small-star step links its smaller ones to it; both keep
the components, and in the end every node hangs on its component's smallest. Each round is written
to the checkpoint folder, so a lost executor costs at most that round; the driver sees two
numbers of a round, never edges. Nodes with a large share of all edges are met by broadcast, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.common import checkpointed, join_told, narrowed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) of every node in some edge.

    Edges are undirected; nulls, loops and repeats are ignored. Nodes may be of any ordered type.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    down = checkpointed(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _state(down)
    for _ in range(rounds if before[0] else 0):
        both = down.union(down.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_told(both.where("v > u"), least, "u", "n", 2 * before[0], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(narrowed(large, before[0]))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_told(large, smallest, "u", "n", before[0], "inner").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = checkpointed(narrowed(smallest.select("u", F.col("m").alias("v")).union(small).distinct(), before[0]))
        after = _state(down)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    kind = down.schema["u"].dataType
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).union(down.select("v", "v").distinct()).select(F.col("node").cast(kind), F.col("component").cast(kind))
