"""Walks over graphs held as edge tables: order along successor links, descendants, readiness and propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def heads(before: DataFrame) -> DataFrame:
    """node, head, dist of every row (node, prior) with one prior a node at most: the node that the priors lead to, and how many steps away it is. A node on or behind a cycle has null for both.

    Pointer doubling: a round joins only what has not arrived, and its rows are written, so the plan does not grow. A round that brings no node further
    ends the walk; there are as many as the logarithm of the longest chain.
    """
    now = written(before.select("node", F.coalesce("prior", "node").alias("head"), F.col("prior").isNotNull().cast("long").alias("dist"), F.col("prior").isNull().alias("done")))
    left = now.where("not done").count()
    while left:
        ahead = now.select(F.col("node").alias("_node"), F.col("head").alias("_head"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        moved = now.where("not done").join(ahead, F.col("head") == F.col("_node"), "left")
        moved = moved.select("node", F.coalesce("_head", "head").alias("head"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.coalesce("_done", F.lit(True)).alias("done"))
        now = written(now.where("done").union(moved))
        rest = now.where("not done").count()
        if rest == left:  # what is left never arrives
            break
        left = rest
    return now.select("node", F.when(F.col("done"), F.col("head")).alias("head"), F.when(F.col("done"), F.col("dist")).alias("dist"))


def mainline_order(nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """id, head, place: each node's place (from 0) on the chain of successor links that reaches it.

    links: (source, target), one successor a node; of several the largest target counts, and of several sources the largest. Nodes on a cycle have no head: head and place are null.
    A link from a node that is not listed starts a chain there.
    """
    before = links.groupBy("source").agg(F.max("target").alias("target")).groupBy(F.col("target").alias("node")).agg(F.max("source").alias("prior"))
    found = heads(nodes.select(F.col(id_col).alias("node")).join(before, "node", "left"))
    return found.select(F.col("node").alias(id_col), "head", F.col("dist").alias("place"))


def leaves(edges: DataFrame, depth: int) -> DataFrame:
    """node, leaf, steps: the leaves that each node of the edges (parent, child) reaches in at most `depth` steps."""
    inner = edges.select(F.col("parent").alias("leaf")).distinct()
    frontier, out = edges.select(F.col("parent").alias("node"), F.col("child").alias("leaf"), F.lit(1).alias("steps")), None
    for _ in range(depth):
        ends = frontier.join(inner, "leaf", "left_anti")
        out = ends if out is None else out.unionByName(ends)
        step = edges.select(F.col("parent").alias("leaf"), "child")
        frontier = frontier.join(step, "leaf").select("node", F.col("child").alias("leaf"), (F.col("steps") + 1).alias("steps"))
    return out.groupBy("node", "leaf").agg(F.min("steps").alias("steps"))


def readiness(deps: DataFrame, status: DataFrame) -> DataFrame:
    """target, n_satisfied, n_waiting, n_blocked, ready: dependencies (target, source, hard) against node states (node, status).

    Done sources satisfy, dropped ones block, others make wait; soft dependencies inform only. Unknown sources make wait.
    """
    state = F.coalesce("status", F.lit("Pending"))
    joined = deps.join(status.select(F.col("node").alias("source"), "status"), "source", "left")
    count = lambda c: F.count(F.when(F.col("hard") & c, 1))
    out = joined.groupBy("target").agg(
        count(state == "Done").alias("n_satisfied"),
        count(~state.isin("Done", "Dropped")).alias("n_waiting"),
        count(state == "Dropped").alias("n_blocked"),
    )
    return out.withColumn("ready", (F.col("n_waiting") == 0) & (F.col("n_blocked") == 0))


def blocked(deps: DataFrame, dropped: DataFrame) -> DataFrame:
    """node: all nodes that are dropped or that a chain of dependencies (target, source) of any length ties to a dropped one.

    Runs of nodes with a single dependency are first led to where they start (`heads`), in a logarithmic number of rounds. Then the dropped starts spread to the nodes with several
    dependencies, a round for each such node in a row. Rows with nulls take no part.
    """
    deps = written(deps.select("target", "source").dropna().distinct())
    gone = written(dropped.select("node").dropna().distinct())
    single = deps.groupBy("target").agg(F.count("*").alias("n"), F.max("source").alias("prior")).where("n = 1").select(F.col("target").alias("node"), "prior")
    single = single.join(gone, "node", "left_anti")
    nodes = deps.select(F.col("target").alias("node")).union(deps.select("source")).union(gone).distinct()
    start = written(heads(nodes.join(single, "node", "left")).where("head is not null").select("node", "head"))
    several = written(deps.join(single.select(F.col("node").alias("target")), "target", "left_anti").join(start.withColumnRenamed("node", "source"), "source").select("target", "head").distinct())
    frontier = out = gone
    while not frontier.isEmpty():
        hit = several.join(frontier.withColumnRenamed("node", "head"), "head", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = written(hit.join(out, "node", "left_anti"))
        out = written(out.union(frontier))
    return start.join(out.withColumnRenamed("node", "head"), "head", "left_semi").select("node").union(out).distinct()


def adjacency(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """id, parent, children, predecessor, successor of every node, from edges (source, target, edge_type); children in order, joined by commas."""
    inside = edges.where("edge_type = 'INCLUSION'")
    parent = inside.groupBy(F.col("target").alias(id_col)).agg(F.min("source").alias("parent"))
    children = inside.groupBy(F.col("source").alias(id_col)).agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("children"))
    chain = edges.where("edge_type = 'MAINLINE'")
    after = chain.groupBy(F.col("source").alias(id_col)).agg(F.min("target").alias("successor"))
    before = chain.groupBy(F.col("target").alias(id_col)).agg(F.min("source").alias("predecessor"))
    out = nodes.select(id_col)
    for side in (parent, children, before, after):
        out = out.join(side, id_col, "left")
    return out


def first_by_priority(parts: list[tuple[DataFrame, int]], target: str, node: str, order: str) -> DataFrame:
    """target, node, place: nodes of prioritised selections (each with an `order`), the first occurrence of each kept."""
    rows = None
    for part, priority in parts:
        one = part.select(target, node, F.lit(priority).alias("p"), F.col(order).cast("long").alias("o"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(target, node).agg(F.min(F.struct("p", "o")).alias("at"))
    place = F.row_number().over(Window.partitionBy(target).orderBy("at.p", "at.o", node))
    return first.select(target, node, place.alias("place"))


def running_ids(nodes: DataFrame, graph: str, level: str, order: str, prefix: str) -> DataFrame:
    """graph, level, order, node_id: ids that count up within a graph and level, as in L2_Step7."""
    n = F.row_number().over(Window.partitionBy(graph, level).orderBy(order))
    return nodes.select(graph, level, order, F.concat(F.col(level), F.lit(f"_{prefix}"), n.cast("string")).alias("node_id"))


def nearest_ancestors(edges: DataFrame, levels: DataFrame, level: str, depth: int) -> DataFrame:
    """node, ancestor, steps: the nearest ancestor of that level within `depth` steps, of equally near ones the smallest; edges (parent, child), levels (node, level). Nodes without one give no row."""
    wanted = levels.where(F.col("level") == level).select(F.col("node").alias("at")).distinct()
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("above")).dropna().distinct()
    frontier = up.select(F.col("at").alias("node"), F.col("above").alias("at"), F.lit(1).alias("steps"))
    hits = frontier.join(wanted, "at", "left_semi")
    for step in range(2, depth + 1):
        frontier = frontier.join(wanted, "at", "left_anti").join(up, "at").select("node", F.col("above").alias("at"), F.lit(step).alias("steps")).distinct()
        hits = hits.unionByName(frontier.join(wanted, "at", "left_semi"))
    return hits.groupBy("node").agg(F.min(F.struct("steps", "at")).alias("x")).select("node", F.col("x.at").alias("ancestor"), F.col("x.steps").alias("steps"))
