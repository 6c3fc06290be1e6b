"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import land


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it sees."""
    near = _both_ways(edges)
    least = near.groupBy(F.col("a").alias("__u")).agg(F.least(F.min("b"), F.col("__u")).alias("m"))
    return (near.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("__u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("__u")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("__u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("__u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    Neighbour lists are only aggregated to their minimum and joined back, never collected, so a hub
    with any number of neighbours is handled; the number of rounds grows with the logarithm of the
    nodes.  Every round is landed; a round that changes nothing ends the loop.
    """
    edges = land(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "cc-edges")
    mark = _mark(edges)
    for i in range(max_rounds):
        edges = land(_small_star(land(_large_star(edges), f"cc-large{i}")), f"cc-small{i}")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
