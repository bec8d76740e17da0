"""Graphs of levels: a root, and below it levels of keyed rows that each name their parent one level up, chains inside groups, and relations; and their integrity rules.

Nodes and edges are tables. Numbers and chains come from range sorts, so neither a document nor a schema that holds a third of all rows passes through one task.
Keys are strings and unique within their level; rows without key take no part. A row whose parent is null hangs on the root (on level 1: stands beside it); one whose parent is unknown has an edge
that `violations` reports. Empty levels give no nodes; without any row below it the root stands alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered, successors, written

#: Kinds of edges, states of nodes, and the phases in which a dependency may be chosen.
EDGE_TYPES = ["INCLUSION", "MAINLINE", "DEPENDENCY"]
STATES = ["Pending", "Active", "Done", "Dropped"]
PRE_WRITE, LIFECYCLE = "pre_write", "state_lifecycle"


@dataclass(frozen=True)
class Level:
    """rows: key, parent (key of the level above, null: the root), doc, place, date (and more). Nodes of a level are numbered by doc, place and key."""

    number: int
    kind: str
    rows: DataFrame
    relation: str


@dataclass(frozen=True)
class Chain:
    """MAINLINE edges between neighbours of a level's rows of one `group` in `order`; with `apart`, only where the two differ in that column."""

    kind: str
    group: str
    order: list[str]
    relation: str
    apart: str | None = None


def level_graph(levels: list[Level], chains: list[Chain], relations: DataFrame | None = None, related: str = "", root: str = "Corpus") -> tuple[DataFrame, DataFrame]:
    """Nodes (level, kind, node, key, doc, place, date) and edges (source, target, edge_type, relation, strength).

    levels from the top down; INCLUSION edges come from parents. relations: left, right (keys of the level `related`), relation, strength: DEPENDENCY edges. Node names are
    as L3_Event7; the root is L1_Corpus0.
    """
    spark = levels[0].rows.sparkSession
    top = spark.range(1).select(F.lit(1).alias("level"), F.lit(root).alias("kind"), F.lit(f"L1_{root}0").alias("node"), F.lit("").alias("key"), *[F.lit(None).cast(t).alias(c) for c, t in (("doc", "string"), ("place", "long"), ("date", "string"))])
    nodes, edges, made, above = top, None, {}, None

    def edge(rows: DataFrame, source: Column, target: Column, kind: str, relation: Column, strength: Column) -> None:
        nonlocal edges
        one = rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), relation.alias("relation"), strength.cast("double").alias("strength"))
        edges = one if edges is None else edges.union(one)

    for level in levels:
        rows = level.rows.where(F.col("key").isNotNull())
        rows = written(numbered(rows, ["doc", "place", "key"]).withColumn("node", F.concat(F.lit(f"L{level.number}_{level.kind}"), F.col("number").cast("string"))))
        made[level.kind] = rows
        nodes = nodes.union(rows.select(F.lit(level.number), F.lit(level.kind), "node", "key", F.col("doc").cast("string"), F.col("place").cast("long"), F.col("date").cast("string")))
        held = rows.select(F.col("node").alias("_node"), "parent")
        if above is not None:
            held = held.join(above.select(F.col("key").alias("parent"), F.col("node").alias("_above")), "parent", "left")
        else:
            held = held.withColumn("_above", F.lit(None).cast("string"))
        source = F.when(F.col("parent").isNull(), f"L1_{root}0").otherwise(F.coalesce("_above", F.concat(F.lit("?"), "parent")))
        if level.number > 1:  # level 1 stands beside the root
            edge(held, source, F.col("_node"), "INCLUSION", F.lit(level.relation), F.lit(1.0))
        above = rows
    for chain in chains:
        keep = ["node", *([chain.apart] if chain.apart else [])]
        next_to = successors(made[chain.kind], chain.group, chain.order, *keep)
        next_to = next_to.where(F.col(f"from_{chain.apart}") != F.col(f"to_{chain.apart}")) if chain.apart else next_to
        edge(next_to, F.col("from_node"), F.col("to_node"), "MAINLINE", F.lit(chain.relation), F.lit(1.0))
    if relations is not None:
        name = lambda c: made[related].select(F.col("key").alias(c), F.col("node").alias(f"_{c}"))
        met = relations.join(name("left"), "left", "left").join(name("right"), "right", "left")
        edge(met, F.coalesce("_left", F.concat(F.lit("?"), "left")), F.coalesce("_right", F.concat(F.lit("?"), "right")), "DEPENDENCY", F.col("relation"), F.col("strength"))
    return nodes, edges


def violations(nodes: DataFrame, edges: DataFrame, phases: bool = True, one_root: bool = True) -> DataFrame:
    """rule, source, target of every broken rule, from one pass over the edges and one over the nodes (there, target is the node).

    nodes: node, level, time, status. edges: source, target, edge_type, phase. Rules: both ends exist; the type is known; INCLUSION goes one level down, MAINLINE stays on its level;
    DEPENDENCY comes neither from level 1 nor from a pending node of level 2, nor from a later or the same time (unknown times pass), and, if `phases`, is chosen before writing for a node of
    level 3 or is a lifecycle edge between nodes of level 4. Nodes have a known status, at most one parent, and (if `one_root`) below level 1 at least one. A node that is listed twice is reported.
    """
    end = lambda side: nodes.groupBy(F.col("node").alias(side)).agg(F.first("level").alias(f"{side}_level"), F.first("time").alias(f"{side}_time"), F.first("status").alias(f"{side}_status"))
    met = edges.join(end("source"), "source", "left").join(end("target"), "target", "left")
    a, b = F.col("source_level"), F.col("target_level")
    both, kind = a.isNotNull() & b.isNotNull(), F.col("edge_type")
    dependency = both & (kind == "DEPENDENCY")
    rules = {
        "missing_source": a.isNull(),
        "missing_target": b.isNull(),
        "unknown_type": kind.isNull() | ~kind.isin(EDGE_TYPES),
        "inclusion_levels": both & (kind == "INCLUSION") & (b != a + 1),
        "mainline_levels": both & (kind == "MAINLINE") & (a != b),
        "from_top": dependency & (a == 1),
        "from_pending": dependency & (a == 2) & (F.col("source_status") == "Pending"),
        "from_future": dependency & (F.col("source_time") > F.col("target_time")),
        "from_same_time": dependency & (F.col("source_time") == F.col("target_time")),
    }
    if phases:
        phase = F.coalesce("phase", F.lit(""))
        rules |= {
            "unknown_phase": dependency & ~phase.isin(PRE_WRITE, LIFECYCLE),
            "pre_write_level": dependency & (phase == PRE_WRITE) & (b != 3),
            "lifecycle_level": dependency & (phase == LIFECYCLE) & ((a != 4) | (b != 4)),
        }
    broken = lambda rules: F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])))
    of_edges = met.select(broken(rules).alias("rule"), "source", "target")
    parents = edges.where("edge_type = 'INCLUSION'").groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("parents"))
    each = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("level").alias("level"), F.min(F.coalesce(F.col("status").isin(STATES), F.lit(False))).alias("known"))
    each = each.join(parents, "node", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    own = {"repeated_node": F.col("n") > 1, "unknown_status": ~F.col("known"), "many_parents": F.col("parents") > 1}
    if one_root:
        own["no_parent"] = (F.col("level") > 1) & (F.col("parents") == 0)
    return of_edges.union(each.select(broken(own).alias("rule"), F.lit(None).cast("string").alias("source"), F.col("node").cast("string").alias("target")))
