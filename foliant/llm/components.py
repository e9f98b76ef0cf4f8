"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, discard, written


def _near(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _near(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """u > v throughout: u and its smaller neighbours are tied to the least of them."""
    least = _near(edges)
    return edges.join(F.broadcast(least) if few else least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for the nodes of `edges` (u, v, longs); the root is the least node of the component.

    Each round is written to the shared folder, and the next one reads it there. Rounds grow with the logarithm of the
    longest path. Hubs are joined, not gathered: a node's neighbours are never in one row. Least neighbours
    are broadcast as far as they are bounded, so that small graphs take fewer tasks.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(edges, "edges")
    mark = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(20,0)")).alias("h")).first()
        if found["n"] == 0 or found == mark:
            break
        mark = found
        few = found["n"] * 4 <= BROADCAST_ROWS  # two ends an edge, two numbers a node
        before, now = now, written(_small_star(_large_star(now, few), few).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError("components: the rounds didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
