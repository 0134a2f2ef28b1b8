"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each neighbour above u goes to u's least neighbour or itself. Small star: u and
    its lower neighbours go to the least of them. The minimum is aggregated before it is joined
    back, so that a hub's edges are never gathered in one place."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    rows = edges.join(least, "u")
    if large:
        rows = rows.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        rows = rows.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return rows.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` has bigint u, v. Returns node, root: the least node of each node's component, for
    all nodes that have an edge to another. Fails if ``max_rounds`` do not suffice."""
    edges = reliable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = reliable(_star(_star(edges, True), False))
        now = tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select("v", "v").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
