"""Connected components by alternating large and small stars, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour ``v`` above ``u`` is tied to the smallest node that ``u`` knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _tie(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the lowest of them. ``u`` is above ``v`` in all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (u, v)``; a component is named by its smallest node.

    Rounds end when the edges no longer change, after about the logarithm of the longest path; only a count and a
    checksum reach the driver. Loops and repeated edges do no harm; nodes without an edge are not returned.
    """
    now = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while (state := _state(now)) != before:
        before = state
        now = written(_tie(_star(now)), name)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
