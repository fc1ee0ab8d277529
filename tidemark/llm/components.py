"""Connected components by alternating large-star and small-star contraction (Kiveris et al., 2014).

Each round is two grouped minima and two joins on the node id. A node with very many links, such as the
centre of a large group of copies, is summed map-side in the minima and split by AQE in the joins. Rounds
are staged in the shared folder, so none is computed twice and lost executors cost one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionAll(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest reachable node.

    Edges are undirected longs. Rows with a null end, loops and repeated edges count as nothing or once;
    without edges the result is empty. A node without links is not in the result: it is its own component."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = stage(_distinct(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())), "edges")
    was, now = None, _state(current)
    while now[0] and now != was:
        large = stage(_large_star(current), "large-star")
        small = stage(_small_star(large), "small-star")
        release(current, large)
        current, was, now = small, now, _state(small)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
