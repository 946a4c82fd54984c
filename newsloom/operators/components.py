"""Connected components by alternating star contractions, with the lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to its least neighbour.

    The least neighbour is a map-side-combined minimum, joined back; a hub's edges are split by the
    adaptive skew join, so no hub is one task.
    """
    turned = edges.select("block", F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        around = edges.unionByName(turned)
    else:
        around = edges.select("block", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("block", "a").agg(F.min("b").alias("m")).select("block", "a", F.least("a", "m").alias("m"))
    joined = around.join(least, ["block", "a"])
    if large:
        links = joined.where(F.col("b") > F.col("a")).select("block", F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        links = joined.select("block", F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return links.where(F.col("a") != F.col("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("block", "a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(block, loc, root)`` of every node on an edge ``(block, a, b)``; the root is the least node."""
    current = cut_lineage(edges.where(F.col("a") != F.col("b")).distinct())
    seen = _fingerprint(current)
    while True:
        current = cut_lineage(_star(_star(current, large=True), large=False))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    roots = current.select("block", F.col("b").alias("loc"), F.col("b").alias("root")).distinct()
    return current.select("block", F.col("a").alias("loc"), F.col("b").alias("root")).unionByName(roots)
