"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour v of u (large: those above u; small: those up to u) moves to the smallest of u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:  # written first: both sides of the join are then plain shuffles, and a hub is split by the skew-join rule
        moved = both.join(materialize(least), "u").where(F.col("v") > F.col("u")).select("v", "m")
    else:
        moved = both.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for each end of the edges (u, v): component is the smallest id that can be reached.

    The aggregates are partial before they are shuffled, and the join of a hub's edges with its minimum can be split; the edges are written to the shared folder in each round, and
    the number of rounds grows with the logarithm of the diameter. Without edges: no rows.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False))
        # A forest of stars has no vertex that is both a leaf and a centre; equal sums mean that nothing moved.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select("u", F.col("v").alias("component")).union(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
        seen = state
