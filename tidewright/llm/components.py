"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch


def _totals(pairs: DataFrame) -> tuple:
    """Count and sum of hashes: other totals are proof that a round has changed something."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("low", "high").cast("decimal(20,0)"))).first())


def _same(pairs: DataFrame, earlier: DataFrame) -> bool:
    """Whether two tables of as many distinct pairs are equal: no pair of the one is missing in the other."""
    return pairs.join(earlier, ["low", "high"], "left_anti").isEmpty()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node that has an edge, with the lowest node it reaches.

    Each round replaces a node's edges by edges to the lowest node around it; rounds grow with the logarithm of the
    longest shortest path, and the last one is found by comparing the tables. Lowest names are partial aggregates and
    the joins back can be split by key, so a node with a third of all edges is spread. No table passes through the
    driver, only two totals per round; the table of a round goes when the next one is written.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct()
    pairs, done = scratch.stored(pairs, "edges-0"), 0
    before = _totals(pairs)
    while True:
        both = pairs.select(F.col("low").alias("node"), F.col("high").alias("near")).unionByName(
            pairs.select(F.col("high").alias("node"), F.col("low").alias("near"))
        )
        lowest = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("lowest"))
        large = both.join(lowest, "node").filter("near > node").select(F.col("near").alias("node"), "lowest")
        large = large.filter("node > lowest").distinct()
        # small star: a node's lower neighbours and itself go to the lowest of them
        lower = large.select("node", F.col("lowest").alias("near"))
        least = lower.groupBy("node").agg(F.min("near").alias("lowest"))
        small = lower.join(least, "node").select(F.col("near").alias("node"), "lowest").unionByName(least.select("node", "lowest"))
        small = small.filter("node > lowest").distinct().select(F.col("lowest").alias("low"), F.col("node").alias("high"))
        earlier, pairs = pairs, scratch.stored(small, f"edges-{done + 1}")
        now = _totals(pairs)
        over = now == before and _same(pairs, earlier)
        scratch.discard(f"edges-{done}")
        if over:
            break
        before, done = now, done + 1
    roots = pairs.groupBy("high").agg(F.min("low").alias("root")).select(F.col("high").alias("node"), "root")
    return roots.unionByName(pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
