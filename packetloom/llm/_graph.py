"""Connected components by alternating large and small stars.

Edges stay distributed; each round is written to the shared folder, so a lost executor
costs a round's tasks and not the iteration's lineage. A round's table goes when the next
one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm._engine import removed, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's greater neighbours move to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges point from the greater to the lesser vertex; all lesser ones move to the least."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the least vertex reachable, for every vertex of an edge (u, v longs).
    Loops and repeated edges do no harm; no edges: no rows."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        old, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        removed(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
