"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, kept


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node on the least of them: the larger ones, or the smaller and itself."""
    near = _both(pairs) if larger else pairs
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = near.join(least, "u")
    if larger:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).where("u != v")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; the component is its least node.

    Edges hold larger node first. The rounds grow with the logarithm of the longest chain; each
    one is written to the shared folder and the one before removed. A node of many edges is
    reduced to one row per task before it is shuffled, and its join is left to skew handling.
    """
    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    seen = _print(now)
    while True:
        after = kept(_star(_star(now, True).distinct(), False).distinct())
        state = _print(after)
        forget(now)
        now = after
        if state == seen:
            break
        seen = state
    # stars by now: every node points at the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
