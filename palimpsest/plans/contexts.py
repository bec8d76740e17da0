"""Queries of packed retrieval contexts, edges from decisions and bootstraps over single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts as C
from ..operators import relations as L
from ..operators import resampling as P
from ..operators import search as S
from ..sources.records import table
from .registry import _CONV_TOKENS, _DOCS, _TOKEN, _TURNS, SQL, _query
from .relations import _KINDS, h5_checked_decisions
from .search import _nearest_sql, _vectors, h1_three_channels


@_query(_nearest_sql("a.id % 50 = 0", "b.id < a.id", 8).replace("WITH ", "WITH RECURSIVE ", 1) + f""", t AS (SELECT query, doc_id AS item, max(len(regexp_extract_all(coalesce(text, ''), {_TOKEN}))) AS v, rank AS nth FROM r JOIN documents ON doc_id = id WHERE rank <= 8 GROUP BY ALL),
  o AS (SELECT query, item, v, row_number() OVER (PARTITION BY query ORDER BY nth) AS p FROM t),
  f AS (SELECT query, item, p, v <= 700 AS fits, CASE WHEN v <= 700 THEN v ELSE 0 END AS used FROM o WHERE p = 1 UNION ALL
    SELECT o.query, o.item, o.p, f.used + o.v <= 700, CASE WHEN f.used + o.v <= 700 THEN f.used + o.v ELSE f.used END FROM f JOIN o ON o.query = f.query AND o.p = f.p + 1)
  SELECT query, item AS id, CAST(used AS BIGINT) AS used FROM f WHERE fits""")
def g20_packed_contexts(spark, sf_dir):
    """What earlier rows bring to each fiftieth one: the eight nearest, as whole texts of at most 700 tokens together."""
    rows = _vectors(spark, sf_dir)
    hits = S.nearest(rows.where("id % 50 = 0"), rows, 8, "earlier")
    return C.packed_hits(hits, _DOCS(spark, sf_dir), "query", "id", "rank", "doc_id", "text", 700)


@_query(f"""WITH i AS (SELECT conv_id, turn AS origin, max(len({_CONV_TOKENS})) AS n, arg_max(coalesce(text, ''), (len({_CONV_TOKENS}), coalesce(text, ''))) AS body FROM conversations WHERE role = 'user' GROUP BY ALL),
  d AS (SELECT p.conv_id, p.turn, i.origin, n, body FROM (SELECT DISTINCT conv_id, turn FROM conversations) p JOIN i ON p.conv_id = i.conv_id AND p.turn BETWEEN origin + 2 AND origin + 6),
  b AS (SELECT *, 120 - coalesce(sum(n) OVER (PARTITION BY conv_id, turn ORDER BY origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d)
  SELECT conv_id, turn, origin, CAST(least(n, room) AS BIGINT) AS n_tokens, n > room AS cut, CASE WHEN n > room THEN array_to_string(regexp_extract_all(body, {_TOKEN})[1:CAST(room AS BIGINT)], ' ') ELSE body END AS body FROM b WHERE room > 0 AND n > 0""")
def g21_packed_schedule(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    return C.packed_schedule(turns.where("role = 'user'"), turns, "conv_id", "turn", "text", 2, 6, 120)


@_query(f"""WITH v AS ({SQL['h5_checked_decisions']}), h AS ({SQL['h1_three_channels']})
  SELECT DISTINCT v.conv_id, v.source, v.target, 'DEPENDENCY' AS edge_type, CASE WHEN referenced THEN 'state_continuity' ELSE 'constraint' END AS relation, round(cosine * 1.25, 8) AS confidence
  FROM v JOIN h USING (conv_id, target, source) WHERE verdict = 'accepted' AND v.source <> v.target - 1""")
def h5_accepted_edges(spark, sf_dir):
    """Accepted decisions as edges; each turn already depends on the one before it."""
    found = h1_three_channels(spark, sf_dir)
    kind = F.when(F.col("referenced"), "state_continuity").when(F.col("structural"), "constraint").otherwise("likely")
    made = found.where("rank <= 4").select("conv_id", "target", "source", kind.alias("kind"), (F.col("cosine") * 1.25).alias("confidence"))
    known = _TURNS(spark, sf_dir).select("conv_id", (F.col("turn") - 1).alias("source"), F.col("turn").alias("target"))
    edges = L.accepted_edges(h5_checked_decisions(spark, sf_dir), made, known, ["conv_id", "target"])
    return edges.withColumn("confidence", F.round("confidence", 8))


def _replicates_sql(rows: str, samples: int, seed: int) -> str:
    """Sums of weights and of weighted values (`k`, `b`, `v`) by group and replicate."""
    steps = ", ".join(map(str, P.POISSON))
    number = f"CAST('0x' || substr(md5({seed} || ':' || k || ':' || (r // 8)), CAST(1 + r % 8 * 4 AS INTEGER), 4) AS INTEGER)"
    return f"""u AS ({rows}), e AS (SELECT b, v, unnest(range({samples})) AS r, k FROM u), w AS (SELECT b, r, CAST(round(v * 1e9) AS HUGEINT) AS v, len(list_filter([{steps}], lambda t: t <= {number})) AS w FROM e),
  m AS (SELECT b, r, round(CAST(sum(w * v) AS DOUBLE) / sum(w) / 1e9, 9) AS m FROM w GROUP BY ALL HAVING sum(w) > 0)"""


@_query(f"""WITH {_replicates_sql("SELECT lang AS b, CAST(doc_id AS VARCHAR) AS k, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL", 200, 13)},
  o AS (SELECT b, list(m ORDER BY m) AS ms FROM m GROUP BY b), a AS (SELECT b, count(*) AS n, round(avg(v), 6) AS mean FROM u GROUP BY b)
  SELECT a.b AS lang, n, mean, round(ms[CAST(floor(0.025 * (len(ms) - 1)) AS BIGINT) + 1], 6) AS low, round(ms[CAST(floor(0.975 * (len(ms) - 1)) AS BIGINT) + 1], 6) AS high FROM a LEFT JOIN o ON a.b IS NOT DISTINCT FROM o.b""")
def l4_mean_bootstrap(spark, sf_dir):
    return P.mean_bootstrap(_DOCS(spark, sf_dir), "lang", "doc_id", "n_chars", 200, 13)


@_query(f"""WITH {_replicates_sql("SELECT source AS b, CAST(doc_id AS VARCHAR) AS k, CAST(quality - toxic AS DOUBLE) AS v FROM documents JOIN labels USING (doc_id) WHERE quality - toxic IS NOT NULL", 200, 7)},
  x AS (SELECT r, round(avg(m), 9) AS m FROM m GROUP BY r), o AS (SELECT list(m ORDER BY m) AS ms, count(*) AS n, count(*) FILTER (m <= 0) AS below, count(*) FILTER (m >= 0) AS above FROM x),
  a AS (SELECT count(*) AS n_strata, round(avg(d), 6) AS difference FROM (SELECT round(avg(v), 9) AS d FROM u GROUP BY b))
  SELECT n_strata, difference, round(ms[greatest(0, CAST(floor(0.025 * n) AS BIGINT) - 1) + 1], 6) AS low, round(ms[least(n - 1, CAST(floor(0.975 * n) AS BIGINT)) + 1], 6) AS high, round(least(1.0, 2.0 * (least(below, above) + 1) / (n + 1)), 9) AS p FROM a, o""")
def l8_stratified_bootstrap(spark, sf_dir):
    rows = _DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("gap", F.col("quality") - F.col("toxic"))
    return P.stratified_bootstrap(rows, "source", "doc_id", "gap", 200, 7)
