"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregates and joins over the edges; the result of a round is
written to the shared folder, so no lineage grows and no edge reaches the driver.
A node's edges are joined to its minimum, not gathered, and the edges of nodes with
many of them stay where they are (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm.spread import spread_join
from decisium.runtime import materialise


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n"))
    star = spread_join(both.filter("b > a"), low, "a", "n", 2 * total)
    return star.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    rest = spread_join(down, low, "a", "n", total).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.select("a", F.col("low").alias("b")).unionByName(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest, the root."""
    now = materialise(edges.filter("a <> b").select("a", "b"), "edges")
    total, state = now.count(), None
    while True:
        large = materialise(_large_star(now, total), "star")
        now = materialise(_small_star(large, large.count()), "star")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total, state = seen["n"], seen
