"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on distinct edges (low, high).

    The larger step hangs every larger neighbour of a node on the node's smallest neighbour;
    the smaller step hangs the node and its smaller neighbours on the smallest of them.  The
    minimum per node is a partial aggregate and the join has no hint, so a node with very many
    neighbours is split like any skewed key.
    """
    if larger:
        sides = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
            edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
        )
        least = sides.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
        hung = sides.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high"))
    else:
        sides = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
        least = sides.groupBy("node").agg(F.min("other").alias("least"))
        own = least.select(F.col("least").alias("low"), F.col("node").alias("high"))
        others = sides.join(least, "node").where("other > least").select(F.col("least").alias("low"), F.col("other").alias("high"))
        hung = own.unionByName(others)
    return hung.distinct()


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node reachable from it.

    Each round is written to the shared folder, so a lost executor costs one round and lineage
    stays short.  Rounds go on until nothing changes; their number grows with the logarithm of
    the longest chain, not with the size of a component.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    found = stored(
        pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges"
    )
    mark = _mark(found)
    while mark[0]:
        found = stored(_stars(_stars(found, larger=True), larger=False), "edges")
        before, mark = mark, _mark(found)
        if before == mark:
            break
    hung = found.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return hung.unionByName(found.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksums of the edges: equal only if nothing changed."""
    row = edges.agg(
        F.count("*").alias("edges"),
        F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("sum"),
        F.sum(F.hash("high", "low").cast("decimal(38,0)")).alias("other"),
    ).first()
    return row["edges"], row["sum"], row["other"]
