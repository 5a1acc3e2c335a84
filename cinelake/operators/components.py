"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) edges with u > v. Minima are aggregated before the join, so hubs stay cheap."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    kept = out.filter(F.col("u") != F.col("v"))
    return kept if large else kept.distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True when every node has one parent and no parent has one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    loose = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c = 1 and p = 1)")
    return loose.isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Alternates large-star and small-star (Kiveris et al., 2014), which needs O(log^2 n) rounds. Edges written
    to the checkpoint folder each round, so a lost executor costs one round at most.
    """
    ordered = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = cut_lineage(ordered)
    for _ in range(max_rounds):
        if _is_forest_of_stars(current):
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        current = cut_lineage(_star(_star(current, large=True), large=False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
