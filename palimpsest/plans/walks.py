"""Queries over graphs: node and edge tables, walks, readiness, views and deltas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import graphs as G
from ..operators import walks as W
from ..sources.records import table
from .registry import _DOCS, _EVENTS, _TURNS, _WORD, _query, e2_ordered_children


@_query("""SELECT CAST(conv_id AS VARCHAR) AS graph, 'L1' AS level, CAST(0 AS BIGINT) AS turn, 'L1_Step1' AS node_id FROM conversations GROUP BY conv_id UNION ALL
  SELECT CAST(conv_id AS VARCHAR), CASE WHEN role = 'user' THEN 'L2' ELSE 'L3' END, turn,
    CASE WHEN role = 'user' THEN 'L2' ELSE 'L3' END || '_Step' || row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) FROM conversations""")
def e1_running_ids(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    graph = F.col("conv_id").cast("string").alias("graph")
    roots = turns.select(graph, F.lit("L1").alias("level"), F.lit(0).cast("long").alias("turn")).distinct()
    steps = turns.select(graph, F.when(F.col("role") == "user", "L2").otherwise("L3").alias("level"), "turn")
    return W.running_ids(roots.unionByName(steps), "graph", "level", "turn", "Step")


@_query(f"""WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), {_WORD}), lambda w: length(w) > 7)) AS facts FROM conversations),
  f AS (SELECT conv_id, turn, unnest(list_sort(facts)[1:3]) AS fact FROM t)
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS source, conv_id || '/' || role AS target, 'INCLUSION' AS edge_type FROM t UNION ALL
  SELECT conv_id || '/' || role, conv_id || ':' || turn, 'INCLUSION' FROM t UNION ALL SELECT conv_id || ':' || turn, conv_id || ':' || turn || '=' || fact, 'DEPENDENCY' FROM f UNION ALL
  SELECT source, target, edge_type FROM (SELECT conv_id || ':' || turn AS source, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target, 'MAINLINE' AS edge_type FROM t) WHERE target IS NOT NULL""")
def e3_conversation_graph(spark, sf_dir):
    facts = F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) > 7))
    t = _TURNS(spark, sf_dir).select("conv_id", "turn", "role", F.concat_ws(":", "conv_id", "turn").alias("step"), F.slice(F.array_sort(facts), 1, 3).alias("facts"))
    stage = F.concat_ws("/", "conv_id", "role")
    edge = lambda rows, source, target, kind: rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"))
    after = t.withColumn("after", F.lead("step").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    fact = t.select("step", F.explode("facts").alias("fact"))
    parts = [
        edge(t, F.col("conv_id").cast("string"), stage, "INCLUSION").distinct(),
        edge(t, stage, F.col("step"), "INCLUSION"),
        edge(fact, F.col("step"), F.concat_ws("=", "step", "fact"), "DEPENDENCY"),
        edge(after, F.col("step"), F.col("after"), "MAINLINE"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_E2 = """e AS (SELECT CAST(conv_id AS VARCHAR) AS source, conv_id || ':' || turn AS target, 'INCLUSION' AS edge_type FROM conversations UNION ALL
  SELECT * FROM (SELECT conv_id || ':' || turn AS source, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target, 'MAINLINE' AS edge_type FROM conversations) WHERE target IS NOT NULL)"""


@_query(f"""WITH {_E2}, n AS (SELECT source AS id FROM e UNION SELECT target FROM e), p AS (SELECT target AS id, min(source) AS parent FROM e WHERE edge_type = 'INCLUSION' GROUP BY target),
  c AS (SELECT source AS id, string_agg(target, ',' ORDER BY target) AS children FROM e WHERE edge_type = 'INCLUSION' GROUP BY source), s AS (SELECT source AS id, min(target) AS successor FROM e WHERE edge_type = 'MAINLINE' GROUP BY source),
  b AS (SELECT target AS id, min(source) AS predecessor FROM e WHERE edge_type = 'MAINLINE' GROUP BY target) SELECT id, parent, children, predecessor, successor FROM n LEFT JOIN p USING (id) LEFT JOIN c USING (id) LEFT JOIN b USING (id) LEFT JOIN s USING (id)""")
def e5_adjacency(spark, sf_dir):
    edges = e2_ordered_children(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    return W.adjacency(nodes, edges, "id")


@_query(f"""WITH {_E2} SELECT source, target, edge_type, CASE WHEN strpos(source, ':') = 0 THEN 'Dropped' ELSE 'Active' END AS status FROM e WHERE edge_type <> 'MAINLINE'""")
def e23_view_without_mainline(spark, sf_dir):
    view = e2_ordered_children(spark, sf_dir).where("edge_type <> 'MAINLINE'")
    return view.select("source", "target", "edge_type", F.when(~F.contains("source", F.lit(":")), "Dropped").otherwise("Active").alias("status"))


@_query("""WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER w AS step, lag(event_id) OVER w AS prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT 'stage:' || user_id AS source, 'call:' || event_id AS target, 'INCLUSION' AS relation FROM c UNION ALL SELECT 'call:' || event_id, 'observation:' || event_id, 'PRODUCES' FROM c UNION ALL
  SELECT 'observation:' || prior, 'call:' || event_id, 'DEPENDENCY' FROM c WHERE prior IS NOT NULL UNION ALL SELECT DISTINCT 'tool:' || event_type, 'stage:' || user_id, 'CAPABILITY' FROM c""")
def e24_execution_graph(spark, sf_dir):
    return G.execution_graph(_EVENTS(spark, sf_dir), "user_id", "event_id", "event_type")


_CHAIN = """o AS (SELECT o_orderkey, row_number() OVER w - 1 AS place, first_value(o_orderkey) OVER w AS head FROM orders WHERE o_orderdate IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@_query(f"WITH {_CHAIN} SELECT o_orderkey, head, place FROM o")
def f2_mainline_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    links = G.dated_chain(orders, "o_custkey", "o_orderdate", "o_orderkey").select("source", "target")
    return W.mainline_order(orders.select("o_orderkey"), links, "o_orderkey")


@_query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
  f AS (SELECT parent AS node, child AS leaf, 1 AS steps FROM e UNION ALL SELECT f.node, e.child, f.steps + 1 FROM f JOIN e ON e.parent = f.leaf)
  SELECT node, leaf, CAST(min(steps) AS INTEGER) AS steps FROM f WHERE leaf NOT IN (SELECT parent FROM e) GROUP BY ALL""")
def f3_leaf_descendants(spark, sf_dir):
    pair = lambda name, a, p, b, c: table(spark, sf_dir, name).select(F.concat(F.lit(a), p).alias("parent"), F.concat(F.lit(b), c).alias("child"))
    edges = pair("nation", "r", "n_regionkey", "n", "n_nationkey").union(pair("customer", "n", "c_nationkey", "c", "c_custkey"))
    return W.leaves(edges.union(pair("supplier", "n", "s_nationkey", "s", "s_suppkey")), 3)


_STATUS = "CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'Dropped' WHEN length(coalesce(text, '')) % 3 = 0 THEN 'Pending' ELSE 'Done' END"


def _steps(spark, sf_dir):
    """Each turn depends on the one before it (hard) and the one before that (soft)."""
    n = F.length(F.coalesce("text", F.lit("")))
    status = F.when(n % 7 == 0, "Dropped").when(n % 3 == 0, "Pending").otherwise("Done")
    w = Window.partitionBy("conv_id").orderBy("turn")
    node = F.concat_ws(":", "conv_id", "turn")
    t = _TURNS(spark, sf_dir).select("conv_id", node.alias("node"), status.alias("status"), F.lag(node).over(w).alias("one"), F.lag(node, 2).over(w).alias("two"))
    dep = lambda c, hard: t.where(F.col(c).isNotNull()).select(F.col("node").alias("target"), F.col(c).alias("source"), F.lit(hard).alias("hard"))
    return t, dep("one", True).union(dep("two", False))


_DEPS = f"""t AS (SELECT conv_id, turn, conv_id || ':' || turn AS node, {_STATUS} AS status, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
  d AS (SELECT a.node AS target, b.node AS source, a.p - b.p = 1 AS hard, b.status FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.p - b.p IN (1, 2))"""


@_query(f"""WITH {_DEPS}, r AS (SELECT target, count(*) FILTER (hard AND status = 'Done') AS n_satisfied, count(*) FILTER (hard AND status = 'Pending') AS n_waiting, count(*) FILTER (hard AND status = 'Dropped') AS n_blocked FROM d GROUP BY target)
  SELECT *, n_waiting = 0 AND n_blocked = 0 AS ready FROM r""")
def f7_readiness(spark, sf_dir):
    steps, deps = _steps(spark, sf_dir)
    return W.readiness(deps, steps.select("node", "status"))


@_query(f"""WITH {_DEPS}, b AS (SELECT *, coalesce(bool_or(status = 'Dropped') OVER (PARTITION BY conv_id ORDER BY turn), false) AS blocked FROM t)
  SELECT conv_id, CAST(count(*) FILTER (blocked) AS BIGINT) AS n_dropped, CASE WHEN bool_and(blocked) THEN 'Dropped' WHEN bool_and(blocked OR status = 'Done') THEN 'Done' ELSE 'Active' END AS stage FROM b GROUP BY conv_id""")
def f8_blocked_rollup(spark, sf_dir):
    steps, deps = _steps(spark, sf_dir)
    gone = W.blocked(deps.where("hard"), steps.where("status = 'Dropped'"))
    t = steps.join(gone.withColumn("gone", F.lit(True)), "node", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    stage = F.when(F.bool_and("gone"), "Dropped").when(F.bool_and(F.col("gone") | (F.col("status") == "Done")), "Done").otherwise("Active")
    return t.groupBy("conv_id").agg(F.count(F.when(F.col("gone"), 1)).alias("n_dropped"), stage.alias("stage"))


@_query("""WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS last FROM conversations GROUP BY conv_id),
  s AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn = last THEN 0 WHEN c.role = l.role THEN 1 WHEN c.turn >= last - 2 THEN 2 END AS p, CASE WHEN c.turn <> last AND c.role = l.role THEN -c.turn ELSE c.turn END AS o FROM conversations c JOIN l USING (conv_id))
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p, o, turn) AS INTEGER) AS place FROM s WHERE p IS NOT NULL""")
def f9_context_order(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    last = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last"))
    t = turns.join(last, "conv_id")
    own = t.where("turn = last").withColumn("o", F.col("turn"))
    same_role = t.where("role = last_role").withColumn("o", -F.col("turn"))  # newest first
    near = t.where("turn >= last - 2").withColumn("o", F.col("turn"))
    return W.first_by_priority([(own, 0), (same_role, 1), (near, 2)], "conv_id", "turn", "o")


@_query(f"""WITH f AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), {_WORD}), lambda w: length(w) > 7))) AS fact FROM conversations),
  g AS (SELECT conv_id, turn, string_agg(fact, ', ' ORDER BY fact) AS facts, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM g)
  SELECT conv_id, turn, facts, n FROM r WHERE rn <= 10""")
def f12_facts_by_turn(spark, sf_dir):
    fact = F.explode(F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) > 7)))
    facts = _TURNS(spark, sf_dir).select("conv_id", "turn", fact.alias("fact"))
    by_turn = facts.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("fact")), ", ").alias("facts"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return by_turn.withColumn("rn", first).where("rn <= 10").drop("rn")


@_query(f"""WITH {_E2}, v AS (SELECT source, target FROM e WHERE edge_type = 'MAINLINE'), n AS (SELECT source, CASE WHEN length(source) % 4 = 0 THEN target || '+' ELSE target END AS target FROM v),
  x AS (SELECT source, target, 'removed' AS change FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM n) UNION ALL SELECT source, target, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM v))
  SELECT source, target, change, length(source) % 4 = 0 AND change = 'removed' AS declared FROM x""")
def m5_edge_delta(spark, sf_dir):
    old = e2_ordered_children(spark, sf_dir).where("edge_type = 'MAINLINE'").select("source", "target")
    moved = F.length("source") % 4 == 0
    new = old.select("source", F.when(moved, F.concat("target", F.lit("+"))).otherwise(F.col("target")).alias("target"))
    declared = old.where(moved).withColumn("change", F.lit("removed"))
    return G.edge_delta(old, new, declared)


@_query("""WITH s AS (SELECT doc_id, source, lower(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g')) AS k FROM documents), g AS (SELECT k, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY k),
  l AS (SELECT k, lang, min(doc_id) AS f FROM s JOIN documents USING (doc_id) GROUP BY ALL), t AS (SELECT k, string_agg(lang, ',' ORDER BY f) AS langs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS rn FROM l) WHERE rn <= 3 GROUP BY k)
  SELECT k, n, first, last, langs FROM g JOIN t USING (k)""")
def e20_group_rollup(spark, sf_dir):
    docs = _DOCS(spark, sf_dir).withColumn("k", F.lower(F.regexp_replace("source", "[^a-zA-Z0-9]", "")))
    return G.rollup(docs, "k", "doc_id", "lang", 3)
