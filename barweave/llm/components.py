"""Connected components by alternating large-star and small-star steps; links stay in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """(node, component): for every node of ``links``, the smallest node it can reach. Loops and repeated links do no harm; an
    empty table gives an empty result. The number of steps grows with the logarithm of the longest path."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "components")
    before = _state(edges)
    for _ in range(max_steps):
        # Large star: every node links its larger neighbours to the smallest node it sees.
        sides = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = materialise(sides.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "components")
        edges = sides.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(edges, "components")
        # Small star: every node links its smaller neighbours, and itself, to the smallest of them.
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "components")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
