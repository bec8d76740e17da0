"""Components of a graph under a cap on their size, merged strongest edge first, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written as _written


def capped_components(edges: DataFrame, most: int) -> DataFrame:
    """node, component, size of every node of the edges (a, b, score): each edge in order of falling score, then a, then b, merges its
    ends' components unless both together exceed `most` nodes. component is its smallest node. Edges with nulls take no part.

    A round merges at once all edges that come first at both of their components: no earlier edge can touch these, so the outcome is that
    of the order. Edges that can't merge any more are dropped. A round is a few joins and two written tables; no component is held by a task.
    There are as many rounds as the longest chain of edges that wait for one another.
    """
    live = _written(edges.select("a", "b", "score").dropna().where("a <> b").select("a", "b", F.struct((-F.col("score")).alias("s"), "a", "b").alias("key"), F.lit(1).alias("na"), F.lit(1).alias("nb")))
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = _written(nodes.select("node", F.col("node").alias("component"), F.lit(1).alias("size")))
    live, rounds = live.where(F.lit(most) >= 2), 0
    while not live.isEmpty():
        ends = live.select("key", F.explode(F.array("a", "b")).alias("c"))
        first = ends.groupBy("c").agg(F.min("key").alias("key"))
        chosen = first.groupBy("key").agg(F.count("*").alias("n")).where("n = 2").select("key").join(live, "key")
        merged = chosen.select(F.least("a", "b").alias("into"), F.greatest("a", "b").alias("gone"), (F.col("na") + F.col("nb")).alias("n"))
        moved = _written(merged.select(F.col("gone").alias("c"), "into", "n").union(merged.select("into", "into", "n")))
        labels = labels.join(moved, F.col("component") == F.col("c"), "left")
        labels, rounds = labels.select("node", F.coalesce("into", "component").alias("component"), F.coalesce("n", "size").alias("size")), rounds + 1
        if rounds % 6 == 0:
            labels = _written(labels)
        for end, size in (("a", "na"), ("b", "nb")):
            at = moved.select(F.col("c").alias(end), F.col("into").alias("_into"), F.col("n").alias("_n"))
            live = live.join(at, end, "left").withColumns({end: F.coalesce("_into", end), size: F.coalesce("_n", size)}).drop("_into", "_n")
        # parallel edges between two components: the first one decides, the rest would find them merged or refused
        live = live.where((F.col("a") != F.col("b")) & (F.col("na") + F.col("nb") <= most))
        low = live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key", F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        live = _written(low.groupBy("a", "b", "na", "nb").agg(F.min("key").alias("key")).select("a", "b", "key", "na", "nb"))
    return labels
