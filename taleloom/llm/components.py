"""Connected components by alternating large-star and small-star rounds.

Each round hangs neighbours under smaller nodes until every component is a star
around its least node. Rounds are joins and sums of DataFrames, stored in the
shared checkpoint folder; a node with very many neighbours is an ordinary skewed
join. No edge list or component is gathered in a task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.session import cut_lineage


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to its least neighbour, or to itself."""
    pairs = edges.select("u", "v").union(edges.select("v", "u"))
    least = _least_neighbour(pairs).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to its least neighbour."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with an edge to another; ``root`` is its component's least node.

    Edges may be repeated, run either way, and join a node to itself. Nodes are
    of any type that has an order and must not be null.
    """
    ordered = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = cut_lineage(ordered.filter("u > v").distinct())
    before = _mark(current)
    while before[0]:
        current = cut_lineage(_small_star(_large_star(current).distinct()))
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
