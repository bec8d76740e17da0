"""Queries of what surrounds a node, of graph profiles, marked units and record checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audits as U
from ..operators import graphs as G
from ..operators import segments as D
from ..operators import walks as W
from ..sources.records import table
from .registry import _DOCS, _TURNS, _query

_GRAPH = """t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS parent, conv_id || ':' || turn AS node, role FROM conversations),
  n AS (SELECT DISTINCT parent AS node, 'L2' AS level FROM t UNION ALL SELECT node, 'L3' FROM t),
  e AS (SELECT parent AS source, node AS target, 'INCLUSION' AS edge_type, NULL AS relation FROM t UNION ALL
    SELECT * FROM (SELECT lag(node) OVER w AS source, node, 'MAINLINE', NULL FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE source IS NOT NULL UNION ALL
    SELECT * FROM (SELECT lag(node, 2) OVER w AS source, node, 'DEPENDENCY', role FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE source IS NOT NULL)"""


def _graph(spark, sf_dir):
    """Conversations over turns, which follow each other and depend on the last but one."""
    node, w = F.concat_ws(":", "conv_id", "turn"), Window.partitionBy("conv_id").orderBy("turn")
    none = F.lit(None).cast("string")
    t = _TURNS(spark, sf_dir).select(F.col("conv_id").cast("string").alias("parent"), node.alias("node"), "role", F.lag(node).over(w).alias("one"), F.lag(node, 2).over(w).alias("two"))
    edge = lambda c, kind, relation: F.struct(F.col(c).alias("source"), F.col("node").alias("target"), F.lit(kind).alias("edge_type"), relation.alias("relation"))
    edges = t.select(F.inline(F.array(edge("parent", "INCLUSION", none), edge("one", "MAINLINE", none), edge("two", "DEPENDENCY", F.col("role"))))).where("source is not null")
    nodes = t.select(F.col("parent").alias("node")).distinct().select("node", F.lit("L2").alias("level")).union(t.select("node", F.lit("L3")))
    return nodes, edges


@_query(f"""WITH {_GRAPH}, x AS (SELECT source AS node, CASE edge_type WHEN 'INCLUSION' THEN 'child' WHEN 'MAINLINE' THEN 'next' ELSE 'dependent' END AS relation, target AS other FROM e UNION
    SELECT target, CASE edge_type WHEN 'INCLUSION' THEN 'parent' WHEN 'MAINLINE' THEN 'previous' ELSE 'dependency' END, source FROM e)
  SELECT x.node, x.relation, other, level FROM x JOIN n ON n.node = other""")
def f1_related(spark, sf_dir):
    return G.related(*_graph(spark, sf_dir))


@_query(f"""WITH {_GRAPH} SELECT 'level' AS kind, level AS name, count(*) AS n FROM n GROUP BY level UNION ALL SELECT 'edge_type', edge_type, count(*) FROM e GROUP BY edge_type UNION ALL
  SELECT 'relation', coalesce(relation, lower(edge_type)), count(*) FROM e GROUP BY 2""")
def e25_graph_profile(spark, sf_dir):
    return G.graph_profile(*_graph(spark, sf_dir))


@_query("""SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS ancestor, 1 AS steps FROM nation UNION ALL
  SELECT DISTINCT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'r' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def f3_nearest_ancestor(spark, sf_dir):
    """The region of every nation, customer and order."""
    pair = lambda name, a, p, b, c: table(spark, sf_dir, name).select(F.concat(F.lit(a), p).alias("parent"), F.concat(F.lit(b), c).alias("child"))
    edges = pair("nation", "r", "n_regionkey", "n", "n_nationkey").union(pair("customer", "n", "c_nationkey", "c", "c_custkey")).union(pair("orders", "c", "o_custkey", "o", "o_orderkey"))
    levels = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("L1").alias("level"))
    return W.nearest_ancestors(edges, levels, "L1", 3)


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  u AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(Th|An|De|La)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM l)
  SELECT doc_id, CAST(unit - 1 AS INTEGER) AS place, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM u WHERE unit > 0 GROUP BY doc_id, unit""")
def d7_marked_units(spark, sf_dir):
    return D.marked_units(_DOCS(spark, sf_dir), "doc_id", "text", "Th|An|De|La")


@_query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN length(t) + 1 ELSE length(t) END AS n, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(t) END AS h FROM d WHERE doc_id % 11 <> 0)
  SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest, CASE WHEN n IS NULL THEN 'missing' WHEN n <> length(t) THEN 'length' WHEN h <> sha256(t) THEN 'digest' WHEN length(t) NOT BETWEEN 1000 AND 4000 THEN 'band' ELSE 'ok' END AS verdict FROM d LEFT JOIN r USING (doc_id)""")
def m8_record_check(spark, sf_dir):
    """Records of which every eleventh is lost, every ninth has another length and every seventh an old digest."""
    docs, text = _DOCS(spark, sf_dir), F.coalesce("text", F.lit(""))
    n = F.length(text).cast("long") + (F.col("doc_id") % 9 == 0).cast("int")
    records = docs.where("doc_id % 11 <> 0").select("doc_id", n.alias("n_chars"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2(text, 256)).alias("digest"))
    return U.record_check(docs, records, "doc_id", "text", 1000, 4000)
