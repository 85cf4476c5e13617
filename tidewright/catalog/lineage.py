"""Lineage as an edge list: closure, order, cycles, impact and connected groups.

The loops run once per level of the graph, not per node, and only what a round found new is joined in the next. Each
round is written to a folder of its own in the shared folder and never again: what is written is the result, once, and
a lost executor costs one round, not the whole loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import cut_lineage, delete_path, scratch_path


class _Rounds:
    """Rows found round by round: ``add`` writes a round's, ``found`` reads all with their round's number."""

    def __init__(self, spark: SparkSession, label: str, number: str):
        self.spark, self.path, self.number = spark, scratch_path(spark, label), number

    def add(self, rows: DataFrame, number: int) -> DataFrame:
        folder = f"{self.path}/{self.number}={number}"
        rows.write.parquet(folder)
        return self.spark.read.parquet(folder)

    def found(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def edges_of(
    spark: SparkSession,
    derivations: Sequence[tuple[str, str, str, str]],
    foreign_keys: Sequence[tuple[str, str, str, str]] = (),
) -> DataFrame:
    """Column edges, upstream to downstream.

    A derivation is (source table, source column, target table, target column); a foreign key is
    (child table, child column, parent table, parent column) and points from parent to child.
    """
    rows = [(f"{a}.{b}", f"{c}.{d}", "derivation") for a, b, c, d in derivations]
    rows += [(f"{c}.{d}", f"{a}.{b}", "foreign_key") for a, b, c, d in foreign_keys]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (ancestor, descendant) pairs with the length of the shortest path between them.

    The pairs of all depths are what is asked, so this is for edges between tables or columns.
    """
    step = cut_lineage(
        edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    )
    rounds = _Rounds(edges.sparkSession, "closure", "depth")
    frontier = rounds.add(step.select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant")), 1)
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        onward = (
            frontier.join(step, F.col("descendant") == F.col("src"))
            .select("ancestor", F.col("dst").alias("descendant"))
            .distinct()
        )
        frontier = rounds.add(onward.join(rounds.found(), ["ancestor", "descendant"], "left_anti"), depth)
    return rounds.found()


def levels(edges: DataFrame) -> DataFrame:
    """Nodes with the round in which all of their inputs were ready; NULL marks a cycle.

    Nodes on a cycle, and everything behind one, never become ready. An edge counts once, in the round after its
    source became ready; a node is ready when as many edges have counted as lead to it.
    """
    spark = edges.sparkSession
    step = cut_lineage(
        edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    )
    inputs = cut_lineage(
        step.select(F.col("src").alias("node"), F.lit(0).alias("n"))
        .unionAll(step.select(F.col("dst").alias("node"), F.lit(1).alias("n")))
        .groupBy("node").agg(F.sum("n").alias("inputs"))
    )
    done, counted = _Rounds(spark, "levels", "level"), _Rounds(spark, "ready-inputs", "round")
    ready = done.add(inputs.filter("inputs = 0").select("node"), 0)
    level = 0
    while not ready.isEmpty():
        level += 1
        reached = step.join(ready, F.col("src") == F.col("node")).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        fresh = counted.add(reached.select(F.col("dst").alias("node"), "n"), level).select("node")
        sums = counted.found().join(fresh, "node", "left_semi").groupBy("node").agg(F.sum("n").alias("n"))
        ready = done.add(sums.join(inputs, "node").filter("n = inputs").select("node"), level)
    found = done.found().select("node", "level")
    stuck = cut_lineage(inputs.select("node").join(found, "node", "left_anti").withColumn("level", F.lit(None).cast("int")))
    delete_path(spark, counted.path)
    return found.unionAll(stuck)


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return closure(edges).filter("ancestor = descendant").select(F.col("ancestor").alias("node"))


def fan_out(edges: DataFrame) -> DataFrame:
    return (
        edges.select("src", "dst")
        .distinct()
        .groupBy(F.col("src").alias("node"))
        .agg(F.count(F.lit(1)).alias("fan_out"))
    )


def impacted(edges: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Changed nodes and everything downstream of them, without the removed ones.

    Only the reachable part is expanded: the frontier starts from the changed nodes.
    """
    step = cut_lineage(edges.select("src", "dst").distinct())
    rounds = _Rounds(edges.sparkSession, "impact", "round")
    frontier = rounds.add(changed.select(F.col(changed.columns[0]).alias("node")).distinct(), 0)
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        onward = (
            frontier.join(step, F.col("node") == F.col("src"))
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        frontier = rounds.add(onward.join(rounds.found(), "node", "left_anti"), depth)
    seen = rounds.found().select("node")
    if removed is not None:
        gone = removed.select(F.col(removed.columns[0]).alias("node"))
        seen = seen.join(gone, "node", "left_anti")
    return seen


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, group): nodes linked by any path share the smallest node name as their group.

    Each round takes the smallest label among the neighbours, then the label of the label, which
    shortens long chains; the rounds grow with the logarithm of the longest chain.
    """
    links = edges.select("src", "dst").filter("src is not null and dst is not null")
    both = cut_lineage(links.unionAll(links.select("dst", "src")).distinct())
    labels = cut_lineage(both.select(F.col("src").alias("node")).distinct().withColumn("group", F.col("node")))
    while True:
        offered = (
            both.join(labels, F.col("dst") == F.col("node"))
            .groupBy("src")
            .agg(F.min("group").alias("offer"))
        )
        lowered = labels.join(offered, F.col("node") == F.col("src"), "left").select(
            "node", F.col("group").alias("was"), F.least("group", "offer").alias("group")
        )
        lowered = cut_lineage(lowered)
        jump = lowered.select(F.col("node").alias("via"), F.col("group").alias("final"))
        stepped = cut_lineage(
            lowered.join(jump, F.col("group") == F.col("via")).select(
                "node", "was", F.col("final").alias("group")
            )
        )
        labels = stepped.select("node", "group")
        if stepped.filter(F.col("was") != F.col("group")).isEmpty():
            return labels
