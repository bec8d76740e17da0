"""Queries of exact vector search, reranking, phrases and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.adapters import first_match
from ..sources.records import table
from .registry import _DOCS, _FOUND, _TURNS, _WORD, _plain, _query

_VECTORS = """v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT id, g, e, sqrt(list_inner_product(e, e)) AS n FROM v)"""
_COSINE = "round(coalesce(list_inner_product(a.e, b.e) / nullif(a.n * b.n, 0), 0), 6)"


def _nearest_sql(queries: str, condition: str, k: int) -> str:
    return f"""WITH {_VECTORS}, s AS (SELECT a.id AS query, b.id, {_COSINE} AS score FROM u a JOIN u b ON a.id <> b.id AND {condition} WHERE {queries}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)"""


def _vectors(spark, sf_dir):
    return S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@_query(_nearest_sql("a.id % 50 = 0", "true", 10) + " SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def g1_cosine_top_k(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return S.nearest(rows.where("id % 50 = 0"), rows, 10)


@_query(_nearest_sql("a.id % 50 = 0", "b.id < a.id", 8) + " SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def g20_as_of_search(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return S.nearest(rows.where("id % 50 = 0"), rows, 8, "earlier")


@_query(_nearest_sql("a.id % 50 = 0", "b.g IN ('0', '1', '2', '3', '4')", 5) + " SELECT query, id, lang, score, CAST(rank AS INTEGER) AS rank FROM r JOIN documents ON id = doc_id WHERE rank <= 5")
def g12_included_entities(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings")
    included = every.join(every.where("label < 5").select("label").distinct(), "label", "left_semi")
    found = S.nearest(_vectors(spark, sf_dir).where("id % 50 = 0"), S.vectors(included, "vec_id", "embedding", "label"), 5)
    return found.join(_DOCS(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), "id").select("query", "id", "lang", "score", "rank")


@_query(_nearest_sql("a.id % 50 = 0", "true", 1) + """, k AS (SELECT query, id AS key, score FROM r WHERE rank = 1)
  SELECT query, key, score, sha256(coalesce(text, '')) AS value_sha256, doc_id IS NOT NULL AS complete FROM k LEFT JOIN documents ON key = doc_id""")
def g13_keyed_memory(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = S.nearest(rows.where("id % 50 = 0"), rows, 1).select("query", F.col("id").alias("key"), "score")
    values = _DOCS(spark, sf_dir).select(F.col("doc_id").alias("key"), F.lit(True).alias("there"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    empty = F.sha2(F.lit(""), 256)
    return found.join(values, "key", "left").select("query", "key", "score", F.coalesce("h", empty).alias("value_sha256"), F.col("there").isNotNull().alias("complete"))


@_query(_nearest_sql("true", "a.g <> b.g", 3) + " SELECT least(query, id) AS a, greatest(query, id) AS b, max(score) AS score FROM r WHERE rank <= 3 AND score >= 0.25 GROUP BY ALL")
def e13_cross_group_neighbours(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return S.undirected(S.nearest(rows, rows, 3, "other"), 0.25)


@_query(f"""WITH {_VECTORS}, x AS (SELECT g, unnest(e) / nullif(n, 0) AS x, unnest(range(0, len(e))) AS d FROM u), m AS (SELECT g, d, avg(coalesce(x, 0)) AS x FROM x GROUP BY ALL),
  c AS (SELECT CAST(g AS BIGINT) AS id, list(x ORDER BY d) AS e FROM m GROUP BY g), w AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM c),
  s AS (SELECT a.id AS query, b.id, {_COSINE} AS score FROM w a JOIN w b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
  SELECT query, id, least(greatest(score, 0), 1) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def e14_centroid_neighbours(spark, sf_dir):
    centres = S.centroids(_vectors(spark, sf_dir))
    return S.nearest(centres, centres, 4).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


_LEXICAL = f"""{_FOUND}, l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS lex FROM h), {_VECTORS},
  p AS (SELECT query, doc, hits, lex, {_COSINE} AS dense FROM l JOIN u a ON a.id = query JOIN u b ON b.id = doc WHERE lex <= 20)"""


@_query(f"""WITH {_LEXICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dense DESC, doc) AS rank FROM p)
  SELECT query, doc, dense AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def g3_two_stage(spark, sf_dir):
    first = R.term_hits(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 20)
    rows = _vectors(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dense"), "doc"))
    found = S.scored_pairs(first.select("query", "doc"), rows, rows).withColumn("rank", rank).where("rank <= 5")
    return found.select("query", "doc", F.col("dense").alias("score"), "rank")


@_query(f"""WITH {_LEXICAL} SELECT query, doc, round(dense + 0.25 / (1 + lex) + 0.02 * least(10, hits), 6) AS score FROM p""")
def g14_candidate_scores(spark, sf_dir):
    first = R.term_hits(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 20).withColumnRenamed("rank", "lex")
    rows = _vectors(spark, sf_dir)
    found = S.scored_pairs(first, rows, rows)
    return found.select("query", "doc", F.round(F.col("dense") + 0.25 / (1 + F.col("lex")) + 0.02 * F.least(F.lit(10), "hits"), 6).alias("score"))


@_query(_nearest_sql("a.id % 50 = 0", "true", 40) + """, n AS (SELECT query, r.id, g, score, rank, row_number() OVER (PARTITION BY query, g ORDER BY rank) AS in_group FROM r JOIN u USING (id) WHERE rank <= 40)
  SELECT query, id, g AS "group", CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS place FROM n WHERE in_group <= 2 QUALIFY place <= 8""")
def g16_seeds_per_group(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = S.nearest(rows.where("id % 50 = 0"), rows, 40).join(rows.select("id", "group"), "id")
    return R.capped(found, "query", "id", "group", "rank", 2, 8)


@_plain
def g22_hashed_bigrams(spark, sf_dir):
    return _TURNS(spark, sf_dir).select("conv_id", "turn", S.hashed_bigrams(F.col("text")).cast("array<int>").alias("buckets"))


_WORDS_OF = f"array_to_string(regexp_extract_all(lower(coalesce(text, '')), {_WORD}), ' ')"


@_query(f"""WITH p AS (SELECT item_id AS query, array_to_string(regexp_extract_all(lower(coalesce(text, '')), {_WORD})[1:3], ' ') AS phrase FROM benchmark), d AS (SELECT doc_id AS doc, {_WORDS_OF} AS w FROM documents)
  SELECT DISTINCT query, doc, phrase FROM p JOIN d ON contains(' ' || w || ' ', ' ' || phrase || ' ') WHERE phrase <> ''""")
def g24_phrase_matches(spark, sf_dir):
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(words(F.col("text")), 1, 3), " ").alias("phrase"))
    return S.phrase_matches(phrases, _DOCS(spark, sf_dir).select(F.col("doc_id").alias("doc"), words(F.col("text")).alias("w")))


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  t AS (SELECT query, doc, source, rank FROM r JOIN documents ON doc = doc_id WHERE rank <= 12), g AS (SELECT query, source, row_number() OVER (PARTITION BY query ORDER BY min(rank)) AS gr FROM t GROUP BY query, source)
  SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN gr <= 3 THEN gr END NULLS LAST, doc) AS INTEGER) AS place FROM t JOIN g USING (query, source)""")
def g25_presentation_order(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    hits = R.term_hits(table(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", "text", 12).join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc")
    groups = hits.groupBy("query", "source").agg(F.min("rank").alias("best"))
    groups = groups.withColumn("gr", F.row_number().over(Window.partitionBy("query").orderBy("best"))).where("gr <= 3")
    placed = hits.join(groups, ["query", "source"], "left")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("gr"), "doc"))
    return placed.select("query", "doc", place.alias("place"))


_CLASSES = [("when", "temporal"), ("compare", "comparison"), ("how many", "count"), ("?", "question")]


@_query("""SELECT doc_id, CASE WHEN contains(t, 'when') THEN 'temporal' WHEN contains(t, 'compare') THEN 'comparison' WHEN contains(t, 'how many') THEN 'count' WHEN contains(t, '?') THEN 'question' ELSE 'other' END AS class,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(19|20)[0-9][0-9]'))), ',') AS years, CAST(len(regexp_extract_all(t, '"[^"]+"')) AS INTEGER) AS n_quoted FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def g8_query_profile(spark, sf_dir):
    t = F.lower(F.coalesce("text", F.lit("")))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    years = F.array_join(F.array_sort(F.array_distinct(found("(?:19|20)[0-9][0-9]"))), ",")
    return _DOCS(spark, sf_dir).select("doc_id", first_match(F.col("text"), _CLASSES, "other").alias("class"), years.alias("years"), F.size(found('"[^"]+"')).alias("n_quoted"))


@_query(f"""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, regexp_extract_all(lower(coalesce(text, '')), {_WORD}) AS w FROM conversations),
  c AS (SELECT conv_id, p, w AS term, count(*) AS n FROM (SELECT conv_id, p, unnest(w) AS w FROM t) GROUP BY ALL), m AS (SELECT conv_id, p, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
  d AS (SELECT a.conv_id, a.p, b.p AS q, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.term = b.term AND b.p BETWEEN a.p - 8 AND a.p - 1 GROUP BY ALL),
  x AS (SELECT a.conv_id, a.turn AS target, b.turn AS source, a.p - b.p <= 2 AS structural, a.role = b.role AS referenced, round(coalesce(dot / (ma.norm * mb.norm), 0), 6) AS cosine
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.p BETWEEN a.p - 8 AND a.p - 1 LEFT JOIN d ON d.conv_id = a.conv_id AND d.p = a.p AND d.q = b.p LEFT JOIN m ma ON ma.conv_id = a.conv_id AND ma.p = a.p LEFT JOIN m mb ON mb.conv_id = b.conv_id AND mb.p = b.p)
  SELECT conv_id, target, source, structural, cosine >= 0.18 AS semantic, referenced, cosine, CAST(row_number() OVER (PARTITION BY conv_id, target ORDER BY cosine DESC, source DESC) AS INTEGER) AS rank
  FROM x WHERE structural OR cosine >= 0.18 OR referenced""")
def h1_three_channels(spark, sf_dir):
    return S.channel_candidates(_TURNS(spark, sf_dir), "conv_id", "turn", "role", "text", 8, 2, 0.18)


@_query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]+|(?:[^\\P{{L}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]|\\p{{N}}|_)+') AS w FROM conversations),
  g AS (SELECT conv_id, turn, unnest(flatten(list_transform(w, lambda r: CASE WHEN regexp_matches(r, '^[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END))) AS term FROM t),
  c AS (SELECT conv_id, turn, term, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
  d AS (SELECT a.conv_id, a.turn AS t1, b.turn AS t2, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL)
  SELECT a.conv_id * 1000 + a.turn AS a, b.conv_id * 1000 + b.turn AS b, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    LEFT JOIN d ON d.conv_id = a.conv_id AND t1 = a.turn AND t2 = b.turn LEFT JOIN m x ON x.conv_id = a.conv_id AND x.turn = a.turn LEFT JOIN m y ON y.conv_id = b.conv_id AND y.turn = b.turn""")
def h2_sparse_cosine(spark, sf_dir):
    """Each turn with the next one."""
    turns = _TURNS(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    pairs = turns.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(turns.select(F.col("id").alias("b")), "b", "left_semi")
    return S.sparse_cosine(pairs, turns, "id", F.col("text"))
