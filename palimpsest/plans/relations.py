"""Queries of segments, entity names, relations, capped edges, named sources and decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import graphs as G
from ..operators import relations as L
from ..operators import search as S
from ..operators.tables import written
from ..sources.records import table
from .registry import _DOCS, _WORD, SQL, _plain, _query, _terms_sql
from .search import _COSINE, _VECTORS, h1_three_channels

_QUOTED_STOP = ", ".join(f"'{w}'" for w in L.STOP)
_PROPER = L.PROPER.replace("'", "''")
#: RE2 has ASCII boundaries: other letters, which no name holds, become "_" first.
_ALIASES = f"""m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\P{{L}}\\x00-\\x7F]', '_', 'g'), '{_PROPER}')) AS m FROM documents),
  c AS (SELECT doc_id, list_filter(regexp_extract_all(m, '[A-Za-z0-9]+'), lambda w: lower(w) NOT IN ('the', 'of', 'and')) AS c FROM m),
  a AS (SELECT doc_id, lower(array_to_string(c, ' ')) AS alias FROM c WHERE len(c) > 1 UNION SELECT doc_id, lower(array_to_string(list_transform(c, lambda w: w[1]), '')) FROM c WHERE len(c) > 1
    UNION SELECT doc_id, lower(c[-1]) FROM c WHERE len(c) > 1 AND length(c[-1]) >= 5 UNION SELECT doc_id, lower(c[1]) FROM c WHERE len(c) = 1 AND length(c[1]) >= 4 AND lower(c[1]) NOT IN ({_QUOTED_STOP})),
  adf AS (SELECT alias, count(*) AS df FROM a GROUP BY alias), al AS (SELECT doc_id, alias, df FROM a JOIN adf USING (alias) WHERE df <= greatest(16, floor((SELECT count(*) FROM documents) * 0.08)))"""


@_query(f"WITH {_ALIASES} SELECT doc_id, alias, df FROM al")
def e16_entity_aliases(spark, sf_dir):
    return L.aliases(_DOCS(spark, sf_dir), "doc_id", "text")


@_query(f"""WITH {_ALIASES}, {_VECTORS}, s AS (SELECT a.id AS query, b.id, {_COSINE} AS score FROM u a JOIN u b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s),
  p AS (SELECT least(query, id) AS a, greatest(query, id) AS b, max(score) AS score FROM r WHERE rank <= 8 AND score >= 0.43 GROUP BY ALL),
  w AS (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM w GROUP BY term), k AS (SELECT * FROM df WHERE df > 1 AND df <= greatest(12, 0.08 * (SELECT count(*) FROM documents))),
  t AS (SELECT doc_id, term FROM w JOIN k USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, term) <= 18),
  x AS (SELECT a, b, count(*) AS n_entities FROM p JOIN al l ON l.doc_id = a JOIN al m ON m.doc_id = b AND m.alias = l.alias GROUP BY ALL), y AS (SELECT a, b, count(*) AS n_terms FROM p JOIN t l ON l.doc_id = a JOIN t m ON m.doc_id = b AND m.term = l.term GROUP BY ALL),
  z AS (SELECT a, b, score, CAST(coalesce(n_entities, 0) AS INTEGER) AS n_entities, CAST(coalesce(n_terms, 0) AS INTEGER) AS n_terms FROM p LEFT JOIN x USING (a, b) LEFT JOIN y USING (a, b))
  SELECT a, b, score, CASE WHEN n_entities > 0 AND (n_terms > 0 OR score >= 0.68) THEN 'same_entity_event' ELSE 'same_attribute' END AS relation, n_entities, n_terms FROM z
  WHERE (n_entities > 0 AND (n_terms > 0 OR score >= 0.68)) OR (n_terms > 0 AND score >= 0.58)""")
def e17_relations(spark, sf_dir):
    docs = _DOCS(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    rows = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    pairs = S.undirected(S.nearest(rows, rows, 8), 0.43)
    return L.related_pairs(pairs, L.aliases(docs, "id", "text"), G.salient_terms(docs, "id", "text"))


_LETTERS = """v AS (SELECT doc_id AS id, CAST(doc_id // 8 AS VARCHAR) AS g, list_transform(range(97, 123), lambda c: CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)) AS e FROM documents), u AS (SELECT id, g, e, sqrt(list_inner_product(e, e)) AS n FROM v)"""


def _letters(spark, sf_dir):
    """Documents as vectors of their letters' counts, eight in a row a group."""

    @F.pandas_udf("array<double>")
    def counts(lowered: pd.Series) -> pd.Series:
        return lowered.map(lambda t: [float(t.count(chr(c))) for c in range(97, 123)])

    return S.vectors(_DOCS(spark, sf_dir).select("doc_id", counts(F.lower(F.coalesce("text", F.lit("")))).alias("e"), F.floor(F.col("doc_id") / 8).alias("g")), "doc_id", "e", "g")


@_query(SQL["e17_relations"].replace(_VECTORS, _LETTERS))
def e17_text_relations(spark, sf_dir):
    docs, rows = _DOCS(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), written(_letters(spark, sf_dir))
    return L.related_pairs(S.undirected(S.nearest(rows, rows, 8), 0.43), L.aliases(docs, "id", "text"), G.salient_terms(docs, "id", "text"))


_NARRATIVE = SQL["e17_relations"].split("  SELECT a, b, score, CASE")[0].replace(_VECTORS, _LETTERS).replace("ON a.id <> b.id)", "ON a.id <> b.id AND a.g = b.g)").replace("WHERE rank <= 8 AND score >= 0.43", "WHERE score >= 0.43").replace("WITH ", "WITH RECURSIVE ", 1)


@_query(f"""{_NARRATIVE}, q AS (SELECT a // 8 AS g, a, b, score, n_entities, n_terms FROM z WHERE abs(a % 8 - b % 8) > 1 AND a % 8 // 3 <> b % 8 // 3 AND ((n_entities > 0 AND score >= 0.58 AND (n_terms > 0 OR score >= 0.70)) OR (n_terms >= 2 AND score >= 0.66))),
  o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, a, b) AS i FROM q),
  f AS (SELECT g, a, b, i, true AS kept, [a, b] AS ends FROM o WHERE i = 1 UNION ALL
    SELECT o.g, o.a, o.b, o.i, len(list_filter(f.ends, lambda x: x = o.a)) < 3 AND len(list_filter(f.ends, lambda x: x = o.b)) < 3,
      CASE WHEN len(list_filter(f.ends, lambda x: x = o.a)) < 3 AND len(list_filter(f.ends, lambda x: x = o.b)) < 3 THEN list_concat(f.ends, [o.a, o.b]) ELSE f.ends END FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1)
  SELECT CAST(o.g AS VARCHAR) AS "group", o.a, o.b, o.score, o.n_entities, o.n_terms FROM o JOIN f ON f.g = o.g AND f.i = o.i WHERE kept""")
def e17_narrative(spark, sf_dir):
    """Eight documents in a row as events of one group, three a scene."""
    docs, rows = _DOCS(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), written(_letters(spark, sf_dir))
    pairs = S.undirected(S.nearest(rows, rows, 7, "same"), 0.43)
    events = rows.select("id", "group", (F.col("id") % 8).alias("place"), F.floor(F.col("id") % 8 / 3).alias("scene"))
    return L.narrative_pairs(pairs, events, L.aliases(docs, "id", "text"), G.salient_terms(docs, "id", "text"))


#: Sixteen vectors in a row are a document.
_BY_DOCUMENT = _VECTORS.replace("CAST(label AS VARCHAR)", "CAST(vec_id // 16 AS VARCHAR)")


def _documents(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return S.vectors(rows.select("vec_id", "embedding", F.floor(F.col("vec_id") / 16).alias("g")), "vec_id", "embedding", "g")


def _segments_sql(most: int, least: int, similarity: float) -> str:
    return f"""WITH RECURSIVE {_BY_DOCUMENT}, o AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY id) AS p, list_transform(e, lambda x: coalesce(x / nullif(n, 0), 0)) AS e FROM u),
  s AS (SELECT g, id, p, 0 AS segment, 1 AS size, e AS total FROM o WHERE p = 1 UNION ALL
    SELECT g, id, p, segment + CAST(cut AS INTEGER), CASE WHEN cut THEN 1 ELSE size + 1 END, CASE WHEN cut THEN e ELSE list_transform(list_zip(total, e), lambda z: z[1] + z[2]) END
    FROM (SELECT o.g, o.id, o.p, o.e, s.segment, s.size, s.total, s.size >= {most} OR (s.size >= {least} AND round(coalesce(list_inner_product(o.e, s.total) / nullif(sqrt(list_inner_product(s.total, s.total)), 0), 0), 9) < {similarity}) AS cut
      FROM s JOIN o ON o.g = s.g AND o.p = s.p + 1)),
  c AS (SELECT g, segment, count(*) AS size FROM s GROUP BY ALL), l AS (SELECT g, max(segment) AS last FROM c GROUP BY g),
  j AS (SELECT l.g, last FROM l JOIN c x ON x.g = l.g AND x.segment = last AND x.size = 1 JOIN c y ON y.g = l.g AND y.segment = last - 1 AND y.size < {most})
  SELECT s.g AS "group", id, CAST(segment - CASE WHEN segment = last THEN 1 ELSE 0 END AS INTEGER) AS segment FROM s LEFT JOIN j USING (g)"""


@_query(_segments_sql(4, 2, 0.38))
def d6_topic_segments(spark, sf_dir):
    return L.segments(_documents(spark, sf_dir), 4, 2, 0.38, True)


@_query(_segments_sql(3, 1, 0.40).split(",\n  c AS")[0] + ' SELECT g AS "group", id, segment FROM s')
def d6_event_segments(spark, sf_dir):
    return L.segments(_documents(spark, sf_dir), 3, 1, 0.40, False)


@_query(_segments_sql(3, 2, 0.42))
def d6_scene_segments(spark, sf_dir):
    return L.segments(_documents(spark, sf_dir), 3, 2, 0.42, True)


@_plain
def e18_capped_edges(spark, sf_dir):
    """Of each group's five nearest neighbours the strongest edges, at most three at a vector."""
    rows = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    pairs = S.undirected(S.nearest(rows, rows, 5, "same"), 0.0)
    return L.capped_degree(pairs.join(rows.select(F.col("id").alias("a"), "group"), "a"), "group", 3)


_NORMAL = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), ' ')"


@_query(f"""WITH n AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), {_WORD})[1:3], ' ') || ' - ' || item_id AS name FROM benchmark WHERE text IS NOT NULL),
  p AS (SELECT name, {_NORMAL.format('name')} AS alias FROM n UNION SELECT name, {_NORMAL.format("split_part(name, '|', 1)")} FROM n UNION SELECT name, {_NORMAL.format("split_part(name, ' - ', 1)")} FROM n),
  a AS (SELECT alias, count(DISTINCT name) AS sources FROM (SELECT * FROM p UNION SELECT name, substr(alias, 5) FROM p WHERE alias LIKE 'the %') WHERE length(alias) >= 3 GROUP BY alias),
  d AS (SELECT doc_id AS query, ' ' || {_NORMAL.format('text')} || ' ' AS t FROM documents), f AS (SELECT query, alias, sources FROM a JOIN d ON contains(t, ' ' || alias || ' '))
  SELECT query, alias, sources FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.query = f.query AND g.alias <> f.alias AND contains(' ' || g.alias || ' ', ' ' || f.alias || ' '))""")
def g6_mentioned_sources(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    named = items.select(F.concat_ws(" - ", F.array_join(F.slice(words(F.col("text")), 1, 3), " "), "item_id").alias("name"))
    return L.mentioned_sources(_DOCS(spark, sf_dir), named, "doc_id", "text", "name")


_KINDS = ["state_continuity", "entity_continuity", "constraint", "causal_support", "long_range_support", "plot_support"]


@_query(f"""WITH h AS ({SQL['h1_three_channels']}), d AS (SELECT conv_id, target, source, CASE WHEN referenced THEN 'state_continuity' WHEN structural THEN 'constraint' ELSE 'likely' END AS kind, cosine * 1.25 AS confidence, referenced FROM h WHERE rank <= 4)
  SELECT conv_id, target, source, CASE WHEN kind = 'likely' THEN 'kind' WHEN confidence > 1 THEN 'confidence' ELSE 'accepted' END AS verdict FROM d UNION ALL SELECT conv_id, target, source, 'missing' FROM h WHERE rank > 4 AND referenced""")
def h5_checked_decisions(spark, sf_dir):
    found = h1_three_channels(spark, sf_dir)
    kind = F.when(F.col("referenced"), "state_continuity").when(F.col("structural"), "constraint").otherwise("likely")
    made = found.where("rank <= 4").select("conv_id", "target", "source", kind.alias("kind"), (F.col("cosine") * 1.25).alias("confidence"), F.lit("near").alias("reason"))
    asked = found.select("conv_id", "target", "source", F.col("referenced").alias("same_key"))
    return L.checked_decisions(asked, made, ["conv_id", "target"], _KINDS, "state_continuity")
