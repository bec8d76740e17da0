"""Queries of evidence lines, entity graphs for local search, keyword answers and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import terms, words
from ..operators import evidence as E
from ..operators import search as S
from ..operators.audits import provenance
from ..sources.records import table
from .registry import _DOCS, _TURNS, _WORD, _query, _terms_sql


@_query(f"""WITH RECURSIVE d AS (SELECT doc_id, lower(coalesce(lang, '')) AS role, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  q AS (SELECT doc_id, role, ls, {_terms_sql('ls[1]', 4)} AS asked, array_to_string(regexp_extract_all(lower(ls[1]), {_WORD})[1:2], ' ') AS phrase FROM d),
  e AS (SELECT doc_id, role, asked, phrase, unnest(range(0, len(ls))) AS line, unnest(ls) AS body FROM q), w AS (SELECT *, regexp_extract_all(lower(body), {_WORD}) AS w FROM e),
  k AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS k FROM w), h AS (SELECT doc_id, line, unnest(list_distinct(list_intersect(w, asked))) AS term FROM k), f AS (SELECT doc_id, term, count(*) AS df FROM h GROUP BY ALL),
  g AS (SELECT doc_id, line, sum(CAST(12 AS DOUBLE) / df) AS told FROM h JOIN f USING (doc_id, term) GROUP BY ALL),
  s AS (SELECT doc_id, line, length(body) AS v, round(coalesce(told, 0) + CASE WHEN phrase <> '' AND contains(k, ' ' || phrase || ' ') THEN 100 ELSE 0 END + CASE WHEN role <> '' AND contains(k, ' ' || role || ' ') THEN 3 ELSE 0 END, 6) AS score FROM k LEFT JOIN g USING (doc_id, line)),
  n AS (SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM s),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS p FROM n WHERE around > 0),
  r AS (SELECT doc_id, line, score, p, v <= 600 AS fits, CASE WHEN v <= 600 THEN v ELSE 0 END AS used FROM o WHERE p = 1 UNION ALL
    SELECT o.doc_id, o.line, o.score, o.p, r.used + v <= 600, CASE WHEN r.used + v <= 600 THEN r.used + v ELSE r.used END FROM r JOIN o ON o.doc_id = r.doc_id AND o.p = r.p + 1)
  SELECT doc_id, CAST(line AS INTEGER) AS line, score, CAST(used AS BIGINT) AS used FROM r WHERE fits""")
def g19_evidence_lines(spark, sf_dir):
    """The lines of each document that tell most about its first line."""
    first = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    phrase = F.array_join(F.slice(words(first), 1, 2), " ")
    items = _DOCS(spark, sf_dir).select("doc_id", "text", terms(first, 4).alias("asked"), phrase.alias("phrase"), F.lower(F.coalesce("lang", F.lit(""))).alias("role"))
    return E.evidence_lines(items, "doc_id", 600)


@_query("""WITH e AS (SELECT s_suppkey AS id, s_name AS title, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  c AS (SELECT id, title, CASE WHEN id % 3 = 0 THEN 'r' || r ELSE 'n' || n END AS community, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS level FROM e),
  k AS (SELECT 'r' || n_regionkey AS community, count(*) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'n' || c_nationkey, count(*) FROM customer GROUP BY ALL),
  u AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS n_units FROM lineitem GROUP BY ALL), x AS (SELECT a.id AS source, b.id AS target, CAST(a.id % 7 AS DOUBLE) / 8 AS weight FROM e a JOIN e b ON b.id = a.id + a.n + 1),
  d AS (SELECT id, count(*) AS degree, round(sum(weight), 6) AS weight FROM (SELECT source AS id, weight FROM x UNION ALL SELECT target, weight FROM x) GROUP BY id)
  SELECT id, title, community, level, rank AS report_rank, coalesce(n_units, 0) AS n_units, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight FROM c LEFT JOIN k USING (community) LEFT JOIN u USING (id) LEFT JOIN d USING (id)""")
def a9_local_graph(spark, sf_dir):
    """Suppliers as entities; regions, nations and (too deep) suppliers as communities; customers rank reports, orders are units."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("n")).join(nation, "n")
    node = lambda letter, c, level, rows: rows.select("id", F.concat(F.lit(letter), c).alias("community"), F.lit(level).alias("level"))
    nodes = node("r", "r", 0, own).union(node("n", "n", 1, own.where("id % 3 <> 0"))).union(node("s", "id", 2, own))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")).join(nation, "n")
    report = lambda letter, c: customers.groupBy(F.concat(F.lit(letter), c).alias("community")).agg(F.count("*").alias("rank"))
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("id"))
    edges = own.select(F.col("id").alias("source"), (F.col("id") + F.col("n") + 1).alias("target"), (F.col("id") % 7 / 8).alias("weight"))
    return E.local_graph(own.select("id", "title"), nodes, report("r", "r").union(report("n", "n")), units, edges, 1)


@_query(f"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), q AS (SELECT conv_id, last, text AS question FROM conversations JOIN l USING (conv_id) WHERE turn = last),
  s AS (SELECT q.conv_id, c.turn, coalesce(c.text, '') AS text, len(list_intersect({_terms_sql('question')}, {_terms_sql('c.text')})) AS n FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn < last)
  SELECT conv_id AS query, 'keyword' AS method, text AS answer, turn AS evidence FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn DESC) = 1""")
def o2_keyword_answers(spark, sf_dir):
    """Each conversation's last turn as a question to the turns before it."""
    turns = _TURNS(spark, sf_dir)
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("last"))
    before = turns.join(last, "conv_id").where("turn < last")
    return E.answered(before.select(F.col("conv_id").alias("query"), "question", F.col("turn").alias("id"), "text"), "keyword")


@_query("SELECT conv_id, turn, CAST(length(coalesce(text, '')) % 16 AS INTEGER) AS n_first FROM conversations")
def o1_embedded_turns(spark, sf_dir):
    """Any function of a column embeds: here sixteen places, of which the first holds the length modulo 16."""
    rows = E.embedded(_TURNS(spark, sf_dir), "text", lambda c: F.concat(F.array((F.length(c) % 16).cast("float")), F.slice(S.hashed_bigrams(c, 16), 2, 15)))
    return rows.select("conv_id", "turn", F.col("vec")[0].cast("int").alias("n_first"))


@_query("""WITH u AS (SELECT conv_id, turn, role = 'user' AS direct, list_filter([turn - 1, turn - 2, turn - 3, turn + 1, -5], lambda s: (s >= 0 AND s < turn) OR (s > turn AND conv_id % 3 = 0) OR (s < 0 AND conv_id % 4 = 0)) AS cited FROM conversations),
  c AS (SELECT conv_id, turn, direct, list_distinct(list_sort(cited, 'DESC')[1:CASE WHEN direct THEN 2 ELSE 3 END]) AS kept, len(cited) AS n_cited FROM u), s AS (SELECT conv_id, turn, unnest(kept) AS s FROM c),
  v AS (SELECT s.conv_id, s.turn, count(*) AS n_sources, count(k.turn) AS n_known, max(s) AS latest FROM s LEFT JOIN conversations k ON k.conv_id = s.conv_id AND k.turn = s GROUP BY ALL)
  SELECT conv_id, turn, CASE WHEN n_cited = 0 THEN 'unsourced' WHEN direct THEN 'direct' ELSE 'transitive' END AS kind, coalesce(n_sources, 0) AS n_sources, coalesce(n_sources = n_known, false) AS verified, coalesce(latest < turn, true) AS no_future FROM c LEFT JOIN v USING (conv_id, turn)""")
def j6_provenance(spark, sf_dir):
    """Turns cite turns before them; some also the next turn, or one that does not exist."""
    places = F.array(F.col("turn") - 1, F.col("turn") - 2, F.col("turn") - 3, F.col("turn") + 1, F.lit(-5).cast("long"))
    may = lambda s: ((s >= 0) & (s < F.col("turn"))) | ((s > F.col("turn")) & (F.col("conv_id") % 3 == 0)) | ((s < 0) & (F.col("conv_id") % 4 == 0))
    turns = _TURNS(spark, sf_dir)
    units = turns.select("conv_id", "turn", (F.col("role") == "user").alias("direct"), F.filter(places, may).alias("cited"))
    return provenance(units, turns.select("conv_id", F.col("turn").alias("source")), "conv_id", "turn", 2, 3)
