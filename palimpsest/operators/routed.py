"""Retrieval over a graph of levels: the best leaves of a query, and leaves that edges lead to from seeds on all levels.

Queries are a stated set; nodes are all. Vectors are compared in tiles (`search.nearest`), paths and scores are joins, and of all paths that lead a query to a node only the best
is kept before leaves are looked up, as nothing but the leaf itself changes the score then. Ties go to the smaller number or path.

Rows are as `search.vectors` makes them: nodes without a usable vector are never found, nor walked through. Queries without one give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import diversified
from .search import nearest, scored_pairs
from .tables import written

#: What an edge of a type weighs on a path, and the least strength that counts.
EDGE_WEIGHT = {"INCLUSION": 0.55, "MAINLINE": 0.65, "DEPENDENCY": 0.95}
LEAST_STRENGTH = 0.45
LEAF = 4


def schema_gate(operator: Column, relation: Column) -> Column:
    """Temporal edges for temporal queries, same-attribute edges for comparisons; others for all."""
    return F.when(relation == "event_temporal_next", operator == "temporal").when(relation == "same_attribute", operator == "comparison").otherwise(F.lit(True))


def schema_bonus(operator: Column, types: Column, relations: Column) -> Column:
    """What the relations on a path add: a little for any told relation, more where it is of the query's kind."""
    has = lambda name: F.array_contains(relations, name)
    told = ("same_entity_event", "same_attribute", "event_temporal_next", "narrative_dependency")
    fits = lambda kind, name: F.when((operator == kind) & has(name), 0.02).otherwise(0.0)
    any_of = F.when(F.arrays_overlap(relations, F.array(*map(F.lit, told))), 0.005).otherwise(0.0)
    return any_of + fits("temporal", "event_temporal_next") + fits("comparison", "same_attribute") + fits("inference", "same_entity_event") + fits("inference", "narrative_dependency")


def edge_gate(operator: Column, relation: Column) -> Column:
    """Without a document to stay in, only chunks of other documents, and those for inference."""
    return (relation == "chunk_crossdoc") & (operator == "inference")


def edge_bonus(operator: Column, types: Column, relations: Column) -> Column:
    first = F.element_at(types, -1)
    return F.when((operator == "temporal") & (first == "MAINLINE"), 0.015).when((operator == "comparison") & F.contains(F.element_at(relations, -1), F.lit("crossdoc")), 0.015).when((operator == "inference") & (first == "DEPENDENCY"), 0.01).otherwise(0.0)


@dataclass(frozen=True)
class Rule:
    """How a query walks: seeds by level, hops, how many leaves of a reached node count, how far below the last direct leaf they may be, and what a path adds to a leaf's score."""

    seeds: dict[int, int]
    hops: int
    direct: int
    cutoff: float
    gate: Callable[[Column, Column], Column]
    bonus: Callable[[Column, Column, Column], Column]
    of_seed: float
    of_target: float
    of_weight: float
    leaves: int = 2
    per_doc: int = 1 << 30
    weights: dict[str, float] = field(default_factory=lambda: EDGE_WEIGHT)


SCHEMA = Rule({4: 8, 3: 6, 2: 4, 1: 2}, 2, 8, 0.18, schema_gate, schema_bonus, 0.01, 0.0, 0.02)
EDGES = Rule({4: 4, 3: 2, 2: 2}, 1, 7, 0.04, edge_gate, edge_bonus, 0.025, 0.015, 0.01, per_doc=3)


def retrieved(queries: DataFrame, nodes: DataFrame, edges: DataFrame, above: DataFrame, rule: Rule, k: int = 10) -> DataFrame:
    """query, place, node, origin (direct or edge_routed), semantic, score, seed, path, relations.

    queries: id, vec, operator. nodes: id, level, doc, text, vec. edges: source, target (ids), edge_type, relation, strength; both ways are walked. above: node, leaf: for each node the leaves below it, a
    leaf being its own. Direct leaves are the rule's nearest ones. Another leaf is led to by a path of at most the rule's hops from a seed to a node of which it is one of the nearest leaves;
    it counts if it is not too far below the last direct leaf. Both kinds are ranked together, without a text twice and with at most `per_doc` leaves of a document.
    """
    nodes = nodes.withColumn("group", F.lit(None).cast("string"))
    asked = queries.select("id", "vec", F.lit(None).cast("string").alias("group"))
    operators = queries.select(F.col("id").alias("query"), "operator")
    most = {level: max(n, rule.direct) if level == LEAF else n for level, n in rule.seeds.items()}
    found = None
    for level, n in most.items():
        one = nearest(asked, nodes.where(F.col("level") == level), n).withColumn("level", F.lit(level))
        found = one if found is None else found.union(one)
    found = written(found.select("query", F.col("id").alias("node"), "score", "rank", "level"))
    direct = found.where((F.col("level") == LEAF) & (F.col("rank") <= rule.direct))
    wanted = F.coalesce(*[F.when(F.col("level") == level, F.col("rank") <= n) for level, n in rule.seeds.items()])
    seeds = found.where(wanted).select("query", F.col("node").alias("seed"), F.greatest(F.lit(0.0), "score").alias("seed_score")).join(operators, "query")
    least = direct.groupBy("query").agg(F.min("score").alias("last"))

    known = nodes.select(F.col("id").alias("target"))
    weight = F.coalesce(*[F.when(F.col("edge_type") == t, w) for t, w in rule.weights.items()]) * F.greatest(F.lit(LEAST_STRENGTH), F.coalesce("strength", F.lit(1.0)))
    way = lambda a, b: edges.select(F.col(a).alias("source"), F.col(b).alias("target"), "edge_type", "relation", weight.alias("step"))
    ways = written(way("source", "target").union(way("target", "source")).join(known, "target", "left_semi").where("step is not null"))
    now = seeds.select("query", "operator", "seed", "seed_score", F.col("seed").alias("at"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("weight"))
    paths = None
    for _ in range(rule.hops):
        on = now.join(ways, now["at"] == ways["source"]).where(~F.array_contains("path", F.col("target")) & rule.gate(F.col("operator"), F.col("relation")))
        now = on.select("query", "operator", "seed", "seed_score", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("types", F.array("edge_type")).alias("types"), (F.col("weight") * F.col("step")).alias("weight"))
        paths = now if paths is None else paths.union(now)
    gain = rule.of_seed * F.col("seed_score") + rule.of_weight * F.col("weight") + rule.bonus(F.col("operator"), F.col("types"), F.col("relations"))
    best = paths.groupBy("query", "at").agg(F.min(F.struct((-F.round(gain, 9)).alias("less"), "path", "relations", "seed")).alias("m"))
    best = written(best.select("query", "at", (-F.col("m.less")).alias("gain"), "m.path", "m.relations", "m.seed"))

    led = best.select("query", "at").join(above.select(F.col("node").alias("at"), "leaf"), "at")
    pairs = led.select("query", F.col("leaf").alias("doc")).distinct()
    if rule.of_target:
        pairs = pairs.union(best.select("query", F.col("at").alias("doc"))).distinct()
    dense = written(scored_pairs(pairs, asked, nodes.select("id", "vec")).select("query", F.col("doc").alias("node"), "dense"))
    near = F.row_number().over(Window.partitionBy("query", "at").orderBy(F.desc("dense"), "leaf"))
    led = led.join(dense.withColumnRenamed("node", "leaf"), ["query", "leaf"]).withColumn("near", near).where(F.col("near") <= rule.leaves)
    led = led.join(best, ["query", "at"]).join(least, "query", "left").where(F.col("dense") >= F.coalesce("last", F.lit(-1.0)) - rule.cutoff)
    if rule.of_target:
        own = dense.select("query", F.col("node").alias("at"), (rule.of_target * F.greatest(F.lit(0.0), "dense")).alias("own"))
        led = led.join(own, ["query", "at"]).withColumn("gain", F.col("gain") + F.col("own"))
    led = led.join(direct.select("query", F.col("node").alias("leaf")), ["query", "leaf"], "left_anti")
    score = F.round(F.col("dense") + F.col("gain"), 9)
    routed = led.groupBy("query", "leaf").agg(F.min(F.struct((-score).alias("less"), "path", "relations", "seed", F.col("dense").alias("semantic"))).alias("m"))
    routed = routed.select("query", F.col("leaf").alias("node"), F.lit("edge_routed").alias("origin"), "m.semantic", (-F.col("m.less")).alias("score"), "m.seed", "m.path", "m.relations")
    plain = direct.select("query", "node", F.lit("direct").alias("origin"), F.col("score").alias("semantic"), "score", F.col("node").alias("seed"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"))
    ranked = plain.union(routed).join(nodes.select(F.col("id").alias("node"), F.col("doc").cast("string").alias("doc"), "text"), "node")
    ranked = written(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))))
    squeezed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    kept = diversified(ranked, "query", "rank", "node", "doc", squeezed, rule.per_doc, k).select("query", "node", "place")
    return kept.join(ranked, ["query", "node"]).select("query", "place", "node", "origin", "semantic", "score", "seed", "path", "relations")


def with_hierarchy(hits: DataFrame, queries: DataFrame, nodes: DataFrame, schema_of: DataFrame) -> DataFrame:
    """query, section, place, node: the query's nearest document (section 0), the schemas of its hits from the nearest on (1), and the hits by schema and by their own order (2).

    hits: query, node. nodes: id, level, place, vec. schema_of: node, schema (ids). A hit without schema comes last in its section.
    """
    asked = queries.select("id", "vec", F.lit(None).cast("string").alias("group"))
    documents = nodes.where("level = 1").withColumn("group", F.lit(None).cast("string"))
    top = nearest(asked, documents, 1).select("query", F.lit(0).alias("section"), F.lit(1).alias("place"), F.col("id").alias("node"))
    placed = hits.select("query", "node").join(schema_of, "node", "left")
    schemas = placed.where("schema is not null").select("query", F.col("schema").alias("doc")).distinct()
    scored = scored_pairs(schemas, asked, nodes.select("id", "vec"))
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dense"), "doc"))
    scored = written(scored.select("query", F.col("doc").alias("schema"), by_score.alias("at")))
    own = placed.join(scored, ["query", "schema"], "left").join(nodes.select(F.col("id").alias("node"), F.col("place").alias("own")), "node")
    along = F.row_number().over(Window.partitionBy("query").orderBy(F.col("at").asc_nulls_last(), "own", "node"))
    evidence = own.select("query", F.lit(2).alias("section"), along.alias("place"), "node")
    return top.union(scored.select("query", F.lit(1), "at", "schema")).union(evidence)
