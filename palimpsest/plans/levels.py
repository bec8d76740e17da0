"""Queries over graphs of levels: eight vectors in a row are a document, three of them an event; every other document has scenes of its own, the rest share schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from ..operators import routed as R
from ..operators import search as S
from ..operators.tables import written
from ..sources.records import table
from .registry import _DOCS, _EVENTS, _plain, _query

_PARTS = """u AS (SELECT vec_id AS v, vec_id // 8 AS d, vec_id % 8 AS p, vec_id % 8 // 3 AS j FROM embeddings),
  n AS (SELECT *, 'e' || d || '_' || j AS event, CASE WHEN d % 2 = 0 THEN 's' || d || '_' || j // 2 ELSE 'x' || d // 10 || '_' || j END AS schema, strftime(DATE '2024-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS date FROM u),
  d1 AS (SELECT d, 'd' || d AS key, min(date) AS date, row_number() OVER (ORDER BY 'd' || d, d, 'd' || d) AS i FROM n GROUP BY d),
  s0 AS (SELECT schema AS key, CASE WHEN min(d % 2) = 0 THEN 'd' || min(d) END AS doc, CASE WHEN min(d % 2) = 0 THEN min(j // 2) ELSE 0 END AS place FROM n GROUP BY schema),
  s1 AS (SELECT *, row_number() OVER (ORDER BY doc NULLS FIRST, place, key) AS i FROM s0),
  e0 AS (SELECT event AS key, 'd' || d AS doc, j AS place, min(schema) AS schema, min(date) AS date FROM n GROUP BY event, d, j),
  e1 AS (SELECT *, row_number() OVER (ORDER BY doc, place, key) AS i FROM e0),
  f1 AS (SELECT 'u' || v AS key, 'd' || d AS doc, p AS place, event, date, row_number() OVER (ORDER BY 'd' || d, p, 'u' || v) AS i FROM n)"""


def _units(spark, sf_dir):
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(v, "embedding", F.floor(v / 8).alias("d"), (v % 8).alias("p")).withColumn("j", F.floor(F.col("p") / 3))
    d, j = F.col("d").cast("string"), F.col("j")
    shared = F.concat(F.lit("x"), F.floor(F.col("d") / 10).cast("string"), F.lit("_"), j.cast("string"))
    scene = F.concat(F.lit("s"), d, F.lit("_"), F.floor(j / 2).cast("string"))
    return rows.select(
        "vec_id", "embedding", F.concat(F.lit("u"), v.cast("string")).alias("key"), F.concat(F.lit("d"), d).alias("doc"), F.col("p").alias("place"), "j",
        F.concat(F.lit("e"), d, F.lit("_"), j.cast("string")).alias("event"), F.when(F.col("d") % 2 == 0, scene).otherwise(shared).alias("schema"), (F.col("d") % 2 == 0).alias("own"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")), "yyyy-MM-dd").alias("date"),
    )


def _mean_vectors(units, key):
    return S.centroids(S.vectors(units, "vec_id", "embedding", key)).select(F.col("group").alias("key"), "vec")


def _pairs(vectors, least):
    """left, right, strength of each vector's two nearest ones, by number of the key."""
    rows = written(vectors.withColumn("id", F.xxhash64("key")).withColumn("group", F.lit(None).cast("string")))
    near = S.undirected(S.nearest(rows, rows, 2), least)
    name = lambda c, to: rows.select(F.col("id").alias(c), F.col("key").alias(to))
    both = near.join(name("a", "x"), "a").join(name("b", "y"), "b")
    return both.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), F.round("score", 4).alias("strength"))


def _schema_graph(spark, sf_dir):
    units = _units(spark, sf_dir)
    documents = units.groupBy("doc").agg(F.min("date").alias("date")).select(F.col("doc").alias("key"), F.lit(None).cast("string").alias("parent"), "doc", F.lit(0).alias("place"), "date")
    own = F.first("own")
    schemas = units.groupBy(F.col("schema").alias("key")).agg(F.when(own, F.min("doc")).alias("doc"), F.when(own, F.min(F.floor(F.col("j") / 2))).otherwise(0).alias("place"))
    schemas = schemas.select("key", F.col("doc").alias("parent"), "doc", "place", F.lit(None).cast("string").alias("date"))
    events = units.groupBy(F.col("event").alias("key"), "doc", F.col("j").alias("place")).agg(F.min("schema").alias("parent"), F.min("date").alias("date"))
    facts = units.select("key", F.col("event").alias("parent"), "doc", "place", "date")
    levels = [L.Level(1, "Document", documents, ""), L.Level(2, "Schema", schemas, "schema_membership"), L.Level(3, "Event", events, "schema_event"), L.Level(4, "Fact", facts, "event_evidence")]
    chains = [L.Chain("Fact", "parent", ["place"], "evidence_next"), L.Chain("Schema", "doc", ["place"], "narrative_scene_next"), L.Chain("Event", "doc", ["place"], "document_event_next"), L.Chain("Event", "parent", ["date", "doc", "place"], "event_temporal_next", "doc")]
    pairs = _pairs(_mean_vectors(units, "event"), 0.25)
    relation = F.when(F.length("left") == F.length("right"), "same_attribute").otherwise("same_entity_event")
    nodes, edges = L.level_graph(levels, chains, pairs.withColumn("relation", relation), "Event")
    return units, nodes, edges


@_query(f"""WITH {_PARTS} SELECT 1 AS level, 'Corpus' AS kind, 'L1_Corpus0' AS node, '' AS key, NULL AS doc, NULL AS place, NULL AS date UNION ALL SELECT 1, 'Document', 'L1_Document' || i, key, key, 0, date FROM d1
  UNION ALL SELECT 2, 'Schema', 'L2_Schema' || i, key, doc, place, NULL FROM s1 UNION ALL SELECT 3, 'Event', 'L3_Event' || i, key, doc, place, date FROM e1 UNION ALL SELECT 4, 'Fact', 'L4_Fact' || i, key, doc, place, date FROM f1""")
def e10_schema_nodes(spark, sf_dir):
    return _schema_graph(spark, sf_dir)[1]


@_query(f"""WITH {_PARTS}, w AS (SELECT v, event, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS m FROM n JOIN embeddings ON vec_id = v),
  c AS (SELECT event, i, avg(x) AS x FROM (SELECT event, unnest(x) / m AS x, unnest(range(len(x))) AS i FROM w) GROUP BY event, i), q AS (SELECT event, list(x ORDER BY i) AS x FROM c GROUP BY event),
  r AS (SELECT a.event AS a, b.event AS b, round(list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x)) / sqrt(list_inner_product(b.x, b.x)), 6) AS s FROM q a JOIN q b ON a.event <> b.event),
  k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC) <= 2), g AS (SELECT least(a, b) AS x, greatest(a, b) AS y, max(s) AS s FROM k WHERE s >= 0.25 GROUP BY ALL),
  t AS (SELECT i, doc, lead(i) OVER (PARTITION BY schema ORDER BY date, doc, place) AS next, lead(doc) OVER (PARTITION BY schema ORDER BY date, doc, place) AS other FROM e1)
  SELECT CASE WHEN s1.doc IS NULL THEN 'L1_Corpus0' ELSE 'L1_Document' || d1.i END AS source, 'L2_Schema' || s1.i AS target, 'INCLUSION' AS edge_type, 'schema_membership' AS relation, CAST(1 AS DOUBLE) AS strength FROM s1 LEFT JOIN d1 ON d1.key = s1.doc
  UNION ALL SELECT 'L2_Schema' || s1.i, 'L3_Event' || e1.i, 'INCLUSION', 'schema_event', 1 FROM e1 JOIN s1 ON s1.key = e1.schema
  UNION ALL SELECT 'L3_Event' || e1.i, 'L4_Fact' || f1.i, 'INCLUSION', 'event_evidence', 1 FROM f1 JOIN e1 ON e1.key = f1.event
  UNION ALL SELECT 'L4_Fact' || i, 'L4_Fact' || next, 'MAINLINE', 'evidence_next', 1 FROM (SELECT i, lead(i) OVER (PARTITION BY event ORDER BY place) AS next FROM f1) WHERE next IS NOT NULL
  UNION ALL SELECT 'L2_Schema' || i, 'L2_Schema' || next, 'MAINLINE', 'narrative_scene_next', 1 FROM (SELECT i, lead(i) OVER (PARTITION BY doc ORDER BY place) AS next FROM s1 WHERE doc IS NOT NULL) WHERE next IS NOT NULL
  UNION ALL SELECT 'L3_Event' || i, 'L3_Event' || next, 'MAINLINE', 'document_event_next', 1 FROM (SELECT i, lead(i) OVER (PARTITION BY doc ORDER BY place) AS next FROM e1) WHERE next IS NOT NULL
  UNION ALL SELECT 'L3_Event' || i, 'L3_Event' || next, 'MAINLINE', 'event_temporal_next', 1 FROM t WHERE doc <> other
  UNION ALL SELECT 'L3_Event' || a.i, 'L3_Event' || b.i, 'DEPENDENCY', CASE WHEN length(x) = length(y) THEN 'same_attribute' ELSE 'same_entity_event' END, round(g.s, 4) FROM g JOIN e1 a ON a.key = x JOIN e1 b ON b.key = y""")
def e10_schema_edges(spark, sf_dir):
    return _schema_graph(spark, sf_dir)[2]


_GRAPH = """g AS (SELECT event_id, event_id AS node, CAST(event_id % 4 + 1 AS INTEGER) AS level, event_id // 3 AS time, CASE event_type WHEN 'click' THEN 'Pending' WHEN 'view' THEN 'Done' WHEN 'error' THEN 'Lost' ELSE 'Active' END AS status FROM events),
  e AS (SELECT event_id - 1 AS source, event_id AS target, CASE WHEN event_id % 4 = 0 THEN 'MAINLINE' ELSE 'INCLUSION' END AS edge_type, NULL AS phase FROM events UNION ALL
    SELECT event_id - event_id % 7, event_id + 2 - event_id % 5, CASE event_id % 6 WHEN 5 THEN 'OTHER' ELSE 'DEPENDENCY' END, ['pre_write', 'state_lifecycle', 'later'][event_id % 3 + 1] FROM events UNION ALL
    SELECT event_id - 5, event_id, 'INCLUSION', NULL FROM events WHERE event_id % 9 = 0),
  m AS (SELECT source, target, edge_type, phase, a.level AS al, b.level AS bl, a.time AS at1, b.time AS bt, a.status AS ast FROM e LEFT JOIN g a ON a.node = source LEFT JOIN g b ON b.node = target),
  dep AS (SELECT * FROM m WHERE al IS NOT NULL AND bl IS NOT NULL AND edge_type = 'DEPENDENCY'),
  inside AS (SELECT target AS node, count(DISTINCT source) AS n FROM e WHERE edge_type = 'INCLUSION' GROUP BY target)"""


@_query(f"""WITH {_GRAPH}, b AS (SELECT 'missing_source' AS rule, source, target FROM m WHERE al IS NULL UNION ALL SELECT 'missing_target', source, target FROM m WHERE bl IS NULL
  UNION ALL SELECT 'unknown_type', source, target FROM m WHERE edge_type NOT IN ('INCLUSION', 'MAINLINE', 'DEPENDENCY') UNION ALL SELECT 'inclusion_levels', source, target FROM m WHERE edge_type = 'INCLUSION' AND bl <> al + 1
  UNION ALL SELECT 'mainline_levels', source, target FROM m WHERE edge_type = 'MAINLINE' AND bl <> al UNION ALL SELECT 'from_top', source, target FROM dep WHERE al = 1 UNION ALL SELECT 'from_pending', source, target FROM dep WHERE al = 2 AND ast = 'Pending'
  UNION ALL SELECT 'from_future', source, target FROM dep WHERE at1 > bt UNION ALL SELECT 'from_same_time', source, target FROM dep WHERE at1 = bt UNION ALL SELECT 'unknown_phase', source, target FROM dep WHERE phase = 'later'
  UNION ALL SELECT 'pre_write_level', source, target FROM dep WHERE phase = 'pre_write' AND bl <> 3 UNION ALL SELECT 'lifecycle_level', source, target FROM dep WHERE phase = 'state_lifecycle' AND (al <> 4 OR bl <> 4)
  UNION ALL SELECT 'unknown_status', NULL, node FROM g WHERE status = 'Lost' UNION ALL SELECT 'many_parents', NULL, g.node FROM g JOIN inside ON inside.node = g.node WHERE n > 1 UNION ALL SELECT 'no_parent', NULL, g.node FROM g LEFT JOIN inside ON inside.node = g.node WHERE level > 1 AND n IS NULL)
  SELECT rule, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target FROM b""")
def m4_violations(spark, sf_dir):
    """A graph over events with every kind of fault in it."""
    n = F.col("event_id")
    status = F.when(F.col("event_type") == "click", "Pending").when(F.col("event_type") == "view", "Done").when(F.col("event_type") == "error", "Lost").otherwise("Active")
    rows = _EVENTS(spark, sf_dir).select(n, status.alias("status"))
    nodes = rows.select(n.cast("string").alias("node"), (n % 4 + 1).cast("int").alias("level"), F.floor(n / 3).alias("time"), "status")
    named = lambda a, b, kind, phase, of=rows: of.select(a.cast("string").alias("source"), b.cast("string").alias("target"), kind.alias("edge_type"), phase.cast("string").alias("phase"))
    phases = F.array(F.lit(L.PRE_WRITE), F.lit(L.LIFECYCLE), F.lit("later"))[(n % 3).cast("int")]
    edges = named(n - 1, n, F.when(n % 4 == 0, "MAINLINE").otherwise("INCLUSION"), F.lit(None))
    edges = edges.union(named(n - n % 7, n + 2 - n % 5, F.when(n % 6 == 5, "OTHER").otherwise("DEPENDENCY"), phases)).union(named(n - 5, n, F.lit("INCLUSION"), F.lit(None), rows.where(n % 9 == 0)))
    return L.violations(nodes, edges)


def _walkable(units, nodes, edges, levels):
    """Nodes with numbers, vectors and texts, edges by number, and the leaves below each node. levels: level to the units' column that names its key."""
    ids = written(nodes.select("node", F.xxhash64("node").alias("id"), "level", "key", "doc", "place"))
    vecs = None
    for level, column in levels.items():
        one = _mean_vectors(units, column).withColumn("level", F.lit(level))
        vecs = one if vecs is None else vecs.union(one)
    walk = written(ids.join(vecs, ["key", "level"]))
    end = lambda c: walk.select(F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    by_number = written(edges.join(end("source"), "source").join(end("target"), "target").select(F.col("_source").alias("source"), F.col("_target").alias("target"), "edge_type", "relation", "strength"))
    leaf = units.select(*set(levels.values()), F.col("key").alias("_leaf")).join(walk.where("level = 4").select(F.col("key").alias("_leaf"), F.col("id").alias("leaf")), "_leaf")
    above = None
    for level, column in levels.items():
        one = leaf.select(F.col(column).alias("key"), "leaf").join(walk.where(F.col("level") == level).select("key", F.col("id").alias("node")), "key").select("node", "leaf")
        above = one if above is None else above.union(one)
    return walk, by_number, written(above)


def _queries(spark, sf_dir):
    rows = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").where("id % 50 = 0")
    kinds = F.array(*map(F.lit, ("temporal", "comparison", "inference")))
    return rows.select("id", "vec", kinds[(F.col("id") / 50 % 3).cast("int")].alias("operator"))


def _texts(spark, sf_dir, walk):
    docs = _DOCS(spark, sf_dir).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("key"), F.lit(4).alias("level"), "text").dropDuplicates(["key"])
    return walk.join(docs, ["key", "level"], "left").withColumn("text", F.coalesce("text", "node"))


def schema_search(spark, sf_dir):
    """The graph, its texts and the queries, as the retrieval takes them."""
    units, nodes, edges = _schema_graph(spark, sf_dir)
    walk, by_number, above = _walkable(units, nodes, edges, {1: "doc", 2: "schema", 3: "event", 4: "key"})
    return _queries(spark, sf_dir), _texts(spark, sf_dir, walk), by_number, above


@_plain
def g10_schema_retrieval(spark, sf_dir):
    queries, walk, edges, above = schema_search(spark, sf_dir)
    hits = R.retrieved(queries, walk, edges, above, R.SCHEMA)
    named = walk.select(F.col("id").alias("node"), F.col("node").alias("name"))
    return hits.join(named, "node").select("query", "place", "name", "origin", "semantic", "score", F.array_join("relations", " > ").alias("route"))


@_plain
def g10_schema_contexts(spark, sf_dir):
    """The hits with the document and the schemas that they stand in."""
    queries, walk, edges, above = schema_search(spark, sf_dir)
    hits = written(R.retrieved(queries, walk, edges, above, R.SCHEMA))
    schemas = above.join(walk.where("level = 2").select(F.col("id").alias("node")), "node").select(F.col("leaf").alias("node"), F.col("node").alias("schema"))
    named = walk.select(F.col("id").alias("node"), F.col("node").alias("name"))
    return R.with_hierarchy(hits, queries, walk, schemas).join(named, "node").select("query", "section", "place", "name")


def _topic_graph(spark, sf_dir):
    """Documents, topics of four chunks and chunks; neighbours inside a document and across documents."""
    units = _units(spark, sf_dir).withColumn("topic", F.concat("doc", F.lit("t"), F.floor(F.col("place") / 4).cast("string")))
    row = lambda key, parent, place: units.groupBy(key.alias("key")).agg(F.min(parent).alias("parent"), F.min("doc").alias("doc"), F.min(place).alias("place"), F.min("date").alias("date"))
    none = F.lit(None).cast("string")
    levels = [L.Level(2, "Doc", row(F.col("doc"), none, F.lit(0)), "corpus_document"), L.Level(3, "Topic", row(F.col("topic"), F.col("doc"), F.floor(F.col("place") / 4)), "document_topic"), L.Level(4, "Chunk", row(F.col("key"), F.col("topic"), F.col("place")), "topic_chunk")]
    chains = [L.Chain("Topic", "doc", ["place"], "topic_next"), L.Chain("Chunk", "doc", ["place"], "chunk_next")]
    rows = written(S.vectors(units, "vec_id", "embedding", "doc"))
    name = lambda c, to: rows.select(F.col("id").alias(c), F.concat(F.lit("u"), F.col("id").cast("string")).alias(to))
    across = S.undirected(S.nearest(rows, rows, 1, "other"), 0.25).join(name("a", "left"), "a").join(name("b", "right"), "b").select("left", "right", F.lit("chunk_crossdoc").alias("relation"), F.round("score", 4).alias("strength"))
    near = S.non_local_neighbours(rows, 2, 0.25).join(units.select(F.col("doc").alias("group"), (F.col("place") + 1).alias("a"), F.col("key").alias("left")), ["group", "a"]).join(units.select(F.col("doc").alias("group"), (F.col("place") + 1).alias("b"), F.col("key").alias("right")), ["group", "b"])
    relations = across.union(near.select("left", "right", F.lit("semantic_nonlocal"), F.round("score", 4)))
    return units, *L.level_graph(levels, chains, relations, "Chunk")


@_plain
def e9_topic_edges(spark, sf_dir):
    return _topic_graph(spark, sf_dir)[2]


def topic_search(spark, sf_dir):
    units, nodes, edges = _topic_graph(spark, sf_dir)
    walk, by_number, above = _walkable(units, nodes, edges, {2: "doc", 3: "topic", 4: "key"})
    return _queries(spark, sf_dir), _texts(spark, sf_dir, walk), by_number, above


@_plain
def g9_edge_routed(spark, sf_dir):
    queries, walk, edges, above = topic_search(spark, sf_dir)
    hits = R.retrieved(queries, walk, edges, above, R.EDGES)
    named = walk.select(F.col("id").alias("node"), F.col("node").alias("name"))
    return hits.join(named, "node").select("query", "place", "name", "origin", "semantic", "score", F.array_join("relations", " > ").alias("route"))
