"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..operators import audits as A
from ..operators import graphs as G
from ..operators import retrieval as R
from ..operators import scoring as K
from ..operators import search as S
from ..operators import segments as D
from ..operators import selection as C
from ..operators import state as N
from ..sources.records import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "g5_idf_routing"

_TOKEN = r"'[\pL\pN_]+|[^\pL\pN_\s]'"
_WORD = r"'[\pL\pN_]+'"


def _terms_sql(text: str, longer_than: int = 2) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), {_WORD}), lambda w: length(w) > {longer_than}))"


def _query(sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _plain(f: Callable) -> Callable:
    """Registers a query that SQL can't express; a brute-force test stands in for it."""
    QUERIES[f.__name__] = f
    return f


_DOCS = lambda s, d: table(s, d, "documents")
_TURNS = lambda s, d: table(s, d, "conversations")
_EVENTS = lambda s, d: table(s, d, "events")


@_query("SELECT source, doc_id, CAST(rn AS INTEGER) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 200")
def a2_interleave(spark, sf_dir):
    return C.interleaved(_DOCS(spark, sf_dir), "source", "doc_id", 200)


@_plain
def a7_wide_matrix(spark, sf_dir):
    """A column for each source, 0 where a language has none; Spark stops with an error beyond spark.sql.pivotMaxValues of them, for which `a7_source_counts` is the exact way.

    A view can't hold columns that only the rows name, so there is no SQL: a test holds it against the long counts.
    """
    return _DOCS(spark, sf_dir).where("source is not null").groupBy("lang").pivot("source").agg(F.count(F.lit(1))).fillna(0)


@_query("SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY lang, source) GROUP BY lang")
def a7_nested_matrix(spark, sf_dir):
    """A line for each language, however many sources there are."""
    each = _DOCS(spark, sf_dir).where("source is not null").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("source", F.concat_ws("=", "source", F.col("n").cast("string")).alias("cell"))))
    return each.groupBy("lang").agg(F.array_join(F.transform(cells, lambda c: c["cell"]), ",").alias("counts"))


@_query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a7_source_counts(spark, sf_dir):
    return _DOCS(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, trim(text) AS content FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def b2_messages(spark, sf_dir):
    from pyspark.sql import Window

    turns = _TURNS(spark, sf_dir).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return turns.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("turn_index"), "role", F.trim("text").alias("content"))


@_query("""SELECT conv_id, substr(sha256(string_agg(CAST(turn AS VARCHAR) || ':' || role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)), 1, 20) AS signature, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def b12_history_signature(spark, sf_dir):
    line = F.concat_ws(":", F.col("turn").cast("string"), F.col("role"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))
    return _TURNS(spark, sf_dir).groupBy("conv_id").agg(F.substring(F.sha2(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n"), 256), 1, 20).alias("signature"), F.count("*").alias("n_messages"))


@_query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'middle' ELSE 'tail' END AS place,
  CASE doc_id % 3 WHEN 0 THEN 'FACT ' || text WHEN 1 THEN substr(text, 1, length(text) // 2) || ' FACT ' || substr(text, length(text) // 2 + 1) ELSE text || ' FACT' END AS body, length(text) // 1000 AS bucket FROM documents""")
def b13_needle(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    at = F.col("doc_id") % 3
    body = F.when(at == 0, F.concat(F.lit("FACT "), "text")).when(at == 1, F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit(" FACT "), F.substring(F.col("text"), half + 1, F.length("text")))).otherwise(F.concat("text", F.lit(" FACT")))
    return _DOCS(spark, sf_dir).select("doc_id", F.when(at == 0, "head").when(at == 1, "middle").otherwise("tail").alias("place"), body.alias("body"), F.floor(F.length("text") / 1000).alias("bucket"))


@_query("""SELECT doc_id, source, CAST(depth AS INTEGER) AS depth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS depth FROM documents) ORDER BY depth, source LIMIT 150""")
def c1_round_robin(spark, sf_dir):
    return C.round_robin(_DOCS(spark, sf_dir), "source", "doc_id", 150)


@_query("""WITH c AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT sum(size) AS total FROM c),
  q AS (SELECT source, 137 * size / total AS quota FROM c, t), f AS (SELECT source, floor(quota) AS base, quota - floor(quota) AS over FROM q),
  r AS (SELECT source, base, row_number() OVER (ORDER BY round(over, 9) DESC, source) AS i, 137 - sum(base) OVER () AS left_over FROM f),
  d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
  SELECT source, doc_id, CAST(rn AS INTEGER) AS rn FROM d JOIN r USING (source) WHERE rn <= base + CASE WHEN i <= left_over THEN 1 ELSE 0 END""")
def c2_proportional(spark, sf_dir):
    return C.proportional(_DOCS(spark, sf_dir), "source", "doc_id", 137)


@_query("""WITH o AS (SELECT doc_id, quality FROM labels), k AS (SELECT o.* FROM o SEMI JOIN (SELECT doc_id FROM documents WHERE n_chars < 2000) a USING (doc_id)),
  n AS (SELECT quality, count(*) - (SELECT count(*) FROM k WHERE k.quality = o.quality) AS need FROM o GROUP BY quality),
  f AS (SELECT d.doc_id, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS quality FROM documents d WHERE n_chars < 2000 AND doc_id NOT IN (SELECT doc_id FROM labels)),
  r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('11:' || doc_id), doc_id) AS rn FROM f)
  SELECT doc_id, quality, true AS kept FROM k UNION ALL SELECT r.doc_id, r.quality, false FROM r JOIN n USING (quality) WHERE rn <= need""")
def c5_refill(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    return C.refill(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs.where("n_chars < 2000"), docs.select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("quality")), "quality", "doc_id", 11)


@_query("""SELECT conv_id, turn, right(b, 100) AS tail, substr(text, 1, 100) AS head FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL""")
def c6_adjacent_excerpts(spark, sf_dir):
    return C.adjacent_excerpts(_TURNS(spark, sf_dir), "conv_id", "turn", "text", 100, 100)


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_TOKEN}) AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, len(t), {step})) AS start FROM t)
  SELECT doc_id, CAST(start // {step} AS INTEGER) AS "window", CAST(start AS INTEGER) AS start, CAST(least({size}, len(t) - start) AS INTEGER) AS n_tokens, array_to_string(t[start + 1:start + {size}], ' ') AS text, sha256(array_to_string(t[start + 1:start + {size}], ' ')) AS text_sha256 FROM s"""


@_query(_windows_sql(512, 512))
def d1_token_windows(spark, sf_dir):
    return D.token_windows(_DOCS(spark, sf_dir), 512)


@_query(_windows_sql(900, 780))
def d1_overlapping_windows(spark, sf_dir):
    return D.token_windows(_DOCS(spark, sf_dir), 900, 120)


@_query("""WITH j AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
  s AS (SELECT conv_id, body, unnest(range(0, length(body), 450)) AS start FROM j)
  SELECT conv_id, CAST(start // 450 AS INTEGER) AS "window", CAST(start AS INTEGER) AS start, substr(body, start + 1, 500) AS body FROM s WHERE start = 0 OR length(body) - start > 50""")
def d2_char_windows(spark, sf_dir):
    return D.char_windows(_TURNS(spark, sf_dir), 500, 50, group="conv_id", order="turn", text=F.coalesce("text", F.lit("")))


@_query("""SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id""")
def d8_session_blocks(spark, sf_dir):
    return D.session_blocks(_TURNS(spark, sf_dir), "conv_id", "turn", "role", "text")


@_query("""SELECT CAST(conv_id AS VARCHAR) AS source, conv_id || ':' || turn AS target, 'INCLUSION' AS edge_type FROM conversations UNION ALL
  SELECT * FROM (SELECT conv_id || ':' || turn AS source, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target, 'MAINLINE' AS edge_type FROM conversations) WHERE target IS NOT NULL""")
def e2_ordered_children(spark, sf_dir):
    rows = _TURNS(spark, sf_dir).select(F.col("conv_id").cast("string").alias("parent"), F.concat_ws(":", "conv_id", "turn").alias("child"), "turn")
    return G.ordered_children(rows, "parent", "child", "turn")


@_query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  o AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM f)
  SELECT user_id, CAST(ordinal AS BIGINT) AS ordinal, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM o GROUP BY ALL""")
def e4_state_runs(spark, sf_dir):
    return G.state_runs(_EVENTS(spark, sf_dir), "user_id", "event_id", "event_type")


@_query("""SELECT * FROM (SELECT o_orderkey AS source, lead(o_orderkey) OVER w AS target, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) AS INTEGER) AS days
  FROM orders WHERE o_orderdate IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE target IS NOT NULL""")
def e11_dated_chain(spark, sf_dir):
    return G.dated_chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@_query("""WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.label, a.p, b.p AS q, round(coalesce(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0), 9) AS score FROM v a JOIN v b ON a.label = b.label AND abs(a.p - b.p) > 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY label, p ORDER BY score DESC, q) AS rn FROM s)
  SELECT label, CAST(least(p, q) AS INTEGER) AS a, CAST(greatest(p, q) AS INTEGER) AS b, max(score) AS score FROM r WHERE rn <= 2 AND score >= 0.25 GROUP BY ALL""")
def e12_non_local_neighbours(spark, sf_dir):
    rows = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return S.non_local_neighbours(rows).select(F.col("group").cast("int").alias("label"), "a", "b", "score")


@_query(f"""WITH t AS (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
  d AS (SELECT term, count(*) AS df FROM t GROUP BY term), k AS (SELECT d.* FROM d, n WHERE df > 1 AND df <= greatest(12, 0.08 * n)),
  r AS (SELECT doc_id, term, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS rank FROM t JOIN k USING (term))
  SELECT doc_id, term, df, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 18""")
def e15_salient_terms(spark, sf_dir):
    return G.salient_terms(_DOCS(spark, sf_dir), "doc_id", "text")


@_query(f"""WITH t AS (SELECT conv_id, turn, unnest({_terms_sql('text', 3)}) AS term FROM conversations),
  p AS (SELECT a.conv_id, a.turn, b.turn AS prior, count(*) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn < a.turn GROUP BY ALL HAVING count(*) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, prior DESC) AS rn FROM p) SELECT conv_id, turn, prior, overlap FROM r WHERE rn <= 2""")
def e22_prior_related(spark, sf_dir):
    return G.prior_related(_TURNS(spark, sf_dir), "conv_id", "turn", "text")


@_query("""WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS source, conv_id || ':' || turn AS target, 'INCLUSION' AS edge_type FROM conversations UNION ALL
  SELECT conv_id || ':' || turn, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn), 'MAINLINE' FROM conversations)
  SELECT edge_type, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM e WHERE target IS NOT NULL GROUP BY edge_type""")
def e25_profile(spark, sf_dir):
    return G.profile(e2_ordered_children(spark, sf_dir))


@_query("""WITH e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS relation, round(least(1.0, sum(l_quantity) / 100), 6) AS weight FROM lineitem GROUP BY ALL),
  k AS (SELECT source, target, greatest(0.45, weight) AS weight FROM e WHERE relation IN ('A', 'N')),
  b AS (SELECT source, target, max(weight) AS weight FROM (SELECT source, target, weight FROM k UNION ALL SELECT target, source, weight FROM k) GROUP BY ALL),
  p AS (SELECT x.source, y.target, x.target AS middle, round(x.weight * y.weight, 9) AS weight FROM b x JOIN b y ON x.target = y.source WHERE y.target <> x.source AND x.source IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 50 = 0)),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY weight DESC, middle) AS rn FROM p) SELECT source, target, middle, weight FROM r WHERE rn = 1""")
def f4_two_hop(spark, sf_dir):
    """From every part whose key 50 divides, over all edges of two relations."""
    edges = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", F.col("l_returnflag").alias("relation")).agg(F.round(F.least(F.lit(1.0), F.sum("l_quantity") / 100), 6).alias("weight"))
    edges = edges.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), "relation", "weight")
    seeds = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return G.two_hop(edges, seeds, ["A", "N"])


@_query("""WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
  SELECT a.user_id, a.event_id, min(abs(a.p - s.p)) AS distance FROM p a JOIN p s ON a.user_id = s.user_id AND s.event_type = 'purchase' AND abs(a.p - s.p) <= 2 GROUP BY ALL""")
def f5_chain_neighbourhood(spark, sf_dir):
    events = _EVENTS(spark, sf_dir)
    return G.chain_neighbourhood(events, events.where("event_type = 'purchase'"), "user_id", "event_id", 2).withColumn("distance", F.col("distance").cast("long"))


@_query("""WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
  l AS (SELECT user_id, p, event_type, max(CASE WHEN event_type = 'signup' THEN p END) OVER w AS a, max(CASE WHEN event_type = 'view' THEN p END) OVER w AS b, max(CASE WHEN event_type = 'purchase' THEN p END) OVER w AS c FROM p WINDOW w AS (PARTITION BY user_id ORDER BY p)),
  s AS (SELECT user_id, least(a, b, c) AS start, p AS "end", p - least(a, b, c) + 1 AS length FROM l WHERE event_type IN ('signup', 'view', 'purchase') AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length, "end") AS rn FROM s) SELECT user_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(length AS INTEGER) AS length FROM r WHERE rn = 1""")
def f6_smallest_cover(spark, sf_dir):
    return G.smallest_cover(_EVENTS(spark, sf_dir), "user_id", "event_id", "event_type", ["signup", "view", "purchase"])


@_query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(coalesce(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def g1_cosine_in_group(spark, sf_dir):
    rows = S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return S.nearest(rows, rows, 5, "same", 9)


_HITS = f"""q AS (SELECT item_id AS query, unnest({_terms_sql('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS doc, unnest({_terms_sql('text')}) AS term FROM documents)"""
#: query, doc, hits: how many of a query's terms a document's lower-cased text holds.
_FOUND = f"""q AS (SELECT DISTINCT item_id AS query, unnest({_terms_sql('text')}) AS term FROM benchmark), b AS (SELECT doc_id AS doc, lower(coalesce(text, '')) AS body FROM documents),
  m AS (SELECT term, doc FROM (SELECT DISTINCT term FROM q) JOIN b ON contains(body, term)), h AS (SELECT query, doc, count(*) AS hits FROM q JOIN m USING (term) GROUP BY ALL)"""


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h UNION ALL
  SELECT item_id, doc_id, 0, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) FROM benchmark, documents WHERE item_id NOT IN (SELECT query FROM h)) SELECT query, doc, hits, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def g2_term_hits(spark, sf_dir):
    return R.term_hits(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 10, fall_back=True)


@_query(f"""WITH {_HITS}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  w AS (SELECT query, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM q LEFT JOIN f USING (term), n), m AS (SELECT query, sum(idf) AS mass FROM w GROUP BY query),
  h AS (SELECT query, doc, sum(idf) AS hit FROM w JOIN d USING (term) GROUP BY ALL), s AS (SELECT query, doc, round(hit / mass, 9) AS score FROM h JOIN m USING (query)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def g5_idf_routing(spark, sf_dir):
    return R.idf_routing(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 10)


@_query("""WITH p AS (SELECT a.o_orderkey AS query, b.o_orderkey AS row, abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY days, row) AS rn FROM p) SELECT query, row, CAST(days AS INTEGER) AS days FROM r WHERE rn = 1""")
def g7_nearest_dated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return R.nearest_dated(orders, orders, "o_custkey", "o_orderkey", "o_orderdate", "o_orderkey", "o_orderdate")


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  t AS (SELECT query, doc, source, rank FROM r JOIN documents ON doc = doc_id WHERE rank <= 40), g AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY rank) AS g FROM t),
  p AS (SELECT query, doc, source, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM g WHERE g <= 2) SELECT query, doc, source, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10""")
def g17_capped(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    hits = R.term_hits(table(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", "text", 40)
    return R.capped(hits.join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc"), "query", "doc", "source", "rank", 2, 10)


@_query("""WITH x AS (SELECT *, count(*) OVER w AS refs, max(event_id) OVER (PARTITION BY user_id) - event_id AS age FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT user_id, event_id, round((0.45 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + 0.30 * least(1.0, log2(1 + refs) / 3) + 0.25 * least(5, abs(value) / 20) / 5) * pow(2.0, -(age / 1000.0) / 40), 9) AS score FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s) SELECT user_id, event_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def h3_activity_pool(spark, sf_dir):
    from pyspark.sql import Window

    events = _EVENTS(spark, sf_dir)
    used = events.withColumn("refs", F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)))
    used = used.withColumn("age", F.max("event_id").over(Window.partitionBy("user_id")) - F.col("event_id"))
    return K.activity(used, "user_id", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0), F.col("refs"), F.least(F.lit(5.0), F.abs("value") / 20), F.col("age") / 1000.0, 5)


_CONV_TOKENS = f"regexp_extract_all(coalesce(text, ''), {_TOKEN})"


@_query(f"""WITH t AS (SELECT conv_id, turn, {_CONV_TOKENS} AS t FROM conversations), r AS (SELECT *, sum(len(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM t),
  m AS (SELECT *, 100 - (run - len(t)) AS room FROM r) SELECT conv_id, turn, CAST(least(len(t), room) AS INTEGER) AS n_tokens, len(t) > room AS cut, array_to_string(t[1:CAST(least(len(t), room) AS BIGINT)], ' ') AS packed FROM m WHERE room > 0 AND len(t) > 0""")
def i1_prefix_pack(spark, sf_dir):
    return D.prefix_pack(_TURNS(spark, sf_dir), "conv_id", "turn", "text", 100)


@_query(f"""WITH t AS (SELECT conv_id, turn, CAST(len({_CONV_TOKENS}) AS INTEGER) AS n_tokens FROM conversations), u AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM t)
  SELECT conv_id, turn, CAST(least(n_tokens, 120) AS INTEGER) AS n_tokens, least(used, 120) AS used FROM u WHERE used <= 120 OR used = n_tokens""")
def i3_newest_first(spark, sf_dir):
    return D.newest_first(_TURNS(spark, sf_dir), "conv_id", "turn", "text", 120)


@_query(f"""WITH t AS (SELECT conv_id, turn, {_CONV_TOKENS} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
  j AS (SELECT a.conv_id, a.turn AS as_of, b.turn, b.t, row_number() OVER w AS rn, sum(len(b.t)) OVER w AS used FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.p <= a.p - 2 AND len(b.t) > 0 WINDOW w AS (PARTITION BY a.conv_id, a.turn ORDER BY b.p DESC))
  SELECT conv_id, as_of, turn, CAST(least(len(t), 120) AS INTEGER) AS n_tokens, len(t) > 120 AS cut, CAST(least(used, 120) AS BIGINT) AS used, array_to_string(t[greatest(len(t) - 119, 1):], ' ') AS body FROM j WHERE rn = 1 OR used <= 120""")
def i3_newest_as_of(spark, sf_dir):
    return D.newest_as_of(_TURNS(spark, sf_dir), "conv_id", "turn", "text", 120)


@_query("""SELECT doc_id, length(text) > 400 AS cut, CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || ' [...] ' || substr(text, length(text) - 199, 200) ELSE text END AS body FROM documents""")
def i4_trimmed(spark, sf_dir):
    return D.trimmed(_DOCS(spark, sf_dir), "doc_id", "text", 400, " [...] ")


@_query(f"""WITH t AS (SELECT conv_id, turn, lag({_CONV_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
  c AS (SELECT *, CASE WHEN len(p) > 0 THEN array_to_string(p[greatest(len(p) - 19, 1):], ' ') END AS carried FROM t)
  SELECT conv_id, turn, carried, CAST(CASE WHEN len(p) > 0 THEN least(len(p), 20) ELSE 0 END AS INTEGER) AS n_tokens, coalesce(len(p) > 20, false) AS cut, sha256(carried) AS carried_sha256 FROM c""")
def i9_previous_tail(spark, sf_dir):
    return D.previous_tail(_TURNS(spark, sf_dir), "conv_id", "turn", "text", 20)


_SQUEEZE = "trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g'))"


@_query(f"""WITH c AS (SELECT item_id AS claim, {_SQUEEZE} AS c FROM benchmark), s AS (SELECT doc_id AS source, {_SQUEEZE} AS s FROM documents)
  SELECT claim, source FROM c JOIN s ON contains(' ' || s || ' ', ' ' || c || ' ') WHERE c <> ''""")
def j2_grounding(spark, sf_dir):
    return R.contained_in(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text")


def _pairs(spark, sf_dir):
    from pyspark.sql import Window

    turns = _TURNS(spark, sf_dir)
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("gold")).where("gold is not null")


@_query(f"""WITH r AS (SELECT * FROM (SELECT conv_id || ':' || turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations) WHERE gold IS NOT NULL),
  p AS (SELECT id, w, count(*) AS np FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_WORD})) AS w FROM r) GROUP BY ALL), g AS (SELECT id, w, count(*) AS ng FROM (SELECT id, unnest(regexp_extract_all(lower(gold), {_WORD})) AS w FROM r) GROUP BY ALL),
  b AS (SELECT id, sum(least(np, ng)) AS same FROM p JOIN g USING (id, w) GROUP BY id),
  n AS (SELECT id, CAST({_SQUEEZE} = trim(regexp_replace(lower(gold), '[ \\t\\n\\r]+', ' ', 'g')) AS INTEGER) AS exact, len(regexp_extract_all(lower(coalesce(text, '')), {_WORD})) + len(regexp_extract_all(lower(gold), {_WORD})) AS t FROM r)
  SELECT id, exact, CAST(round(CASE WHEN t = 0 THEN 1.0 ELSE CAST(2.0 * coalesce(same, 0) AS DOUBLE) / t END, 9) AS DOUBLE) AS f1 FROM n LEFT JOIN b USING (id)""")
def k1_answer_scores(spark, sf_dir):
    return K.answer_scores(_pairs(spark, sf_dir), "id", "text", "gold")


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  c AS (SELECT item_id AS query, {_SQUEEZE} AS c FROM benchmark), s AS (SELECT doc_id AS doc, {_SQUEEZE} AS s FROM documents),
  g AS (SELECT DISTINCT query, doc FROM c JOIN s ON contains(' ' || s || ' ', ' ' || c || ' ') WHERE c <> ''), n AS (SELECT query, count(*) AS n_gold FROM g GROUP BY query),
  f AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS nth FROM r JOIN g USING (query, doc) WHERE rank <= 10), x AS (SELECT query, min(rank) AS first, sum(nth / rank) AS s FROM f GROUP BY query)
  SELECT query, CAST(coalesce(first <= 4, false) AS INTEGER) AS hit4, CAST(coalesce(first <= 10, false) AS INTEGER) AS hit10, round(coalesce(1 / first, 0), 9) AS mrr10, round(coalesce(s / least(n_gold, 10), 0), 9) AS ap10 FROM n LEFT JOIN x USING (query)""")
def k7_ranking_metrics(spark, sf_dir):
    gold = j2_grounding(spark, sf_dir).select(F.col("claim").alias("query"), F.col("source").alias("doc"))
    return R.ranking_metrics(g2_term_hits(spark, sf_dir), gold)


@_query("""SELECT event_type, CAST(user_id % 4 AS BIGINT) AS phase, count(*) AS calls, round(sum(v), 4) AS total, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
  FROM (SELECT event_type, user_id, user_id % 4 AS phase, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY CUBE (event_type, phase)""".replace("CAST(user_id % 4 AS BIGINT) AS phase", "phase"))
def k14_usage(spark, sf_dir):
    rows = _EVENTS(spark, sf_dir).select("event_type", (F.col("user_id") % 4).alias("phase"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return K.usage(rows, ["event_type", "phase"], "v")


@_query("""SELECT source, lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(CASE WHEN count(n_chars) > 1 THEN 1.96 * stddev_samp(n_chars) / sqrt(count(n_chars)) ELSE 0 END, 6) AS half_width FROM documents GROUP BY source, lang""")
def l1_summary(spark, sf_dir):
    return K.summary(_DOCS(spark, sf_dir), ["source", "lang"], "n_chars")


@_query("""WITH a AS (SELECT source, count(quality) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source)
  SELECT source, n, round(p, 9) AS rate, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS low,
  round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS high FROM a""")
def l6_wilson(spark, sf_dir):
    return K.wilson(_DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id"), "source", "quality")


_MCNEMAR = """m AS (SELECT source, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_first, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_second FROM documents JOIN labels USING (doc_id) GROUP BY source),
  x AS (SELECT *, only_first + only_second AS n, unnest(range(0, least(only_first, only_second) + 1)) AS i FROM m),
  t AS (SELECT source, only_first, only_second, round(CASE WHEN any_value(n) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 6) AS p FROM x GROUP BY source, only_first, only_second)"""


@_query(f"WITH {_MCNEMAR} SELECT * FROM t")
def l7_mcnemar(spark, sf_dir):
    return K.mcnemar(_DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id"), "source", "quality", "toxic")


@_query(f"""WITH {_MCNEMAR}, s AS (SELECT CASE WHEN source < 'src2' THEN 'a' ELSE 'b' END AS family, source, p, least(1.0, (count(*) OVER (PARTITION BY CASE WHEN source < 'src2' THEN 'a' ELSE 'b' END) - row_number() OVER (PARTITION BY CASE WHEN source < 'src2' THEN 'a' ELSE 'b' END ORDER BY p, source) + 1) * p) AS x FROM t)
  SELECT family, source, round(max(x) OVER (PARTITION BY family ORDER BY p, source ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s""")
def l9_holm(spark, sf_dir):
    return K.holm(l7_mcnemar(spark, sf_dir).withColumn("family", F.when(F.col("source") < "src2", "a").otherwise("b")), "family", "source", "p")


@_query("""SELECT count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, min(n_chars) AS least, max(n_chars) AS most, round(avg(CASE WHEN text IS NULL OR text = '' THEN 1.0 ELSE 0 END), 9) AS empty_rate FROM documents""")
def l12_data_profile(spark, sf_dir):
    return _DOCS(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg(F.when(F.col("text").isNull() | (F.col("text") == ""), 1.0).otherwise(0.0)), 9).alias("empty_rate"))


@_query("""WITH e AS (SELECT doc_id, length(text) AS n FROM documents), f AS (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 11 <> 0)
  SELECT doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' WHEN e.n IS NOT DISTINCT FROM f.n THEN 'match' ELSE 'mismatch' END AS verdict FROM e FULL JOIN f USING (doc_id)""".replace("f.doc_id IS NULL", "f.n IS NULL AND doc_id % 11 = 0"))
def m8_record_reconciliation(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    return N.reconciled(docs.select("doc_id", F.length("text").cast("long").alias("n")), docs.where("doc_id % 11 <> 0").select("doc_id", F.col("n_chars").alias("n")), "doc_id", "n")


@_query("""SELECT user_id, event_type, CAST(row_number() OVER w AS INTEGER) AS version, event_id, value, lag(event_id) OVER w AS prior, lead(event_id) OVER w AS superseded_by, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def n1_versions(spark, sf_dir):
    return N.versions(_EVENTS(spark, sf_dir), ["user_id", "event_type"], "event_id", "value")


@_query("SELECT user_id, event_type, count(*) AS n_versions, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def n1_latest(spark, sf_dir):
    return N.latest(_EVENTS(spark, sf_dir), ["user_id", "event_type"], "event_id", "value")


@_query("""SELECT user_id, event_id, event_type, count(*) OVER w AS refs, max(event_id) OVER w AS last_use FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def n4_usage_as_of(spark, sf_dir):
    return N.as_of_usage(_EVENTS(spark, sf_dir), "user_id", "event_type", "event_id")


@_query(f"""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents SEMI JOIN labels USING (doc_id)), n AS (SELECT doc_id, sha256({_SQUEEZE}) AS h FROM documents WHERE {_SQUEEZE} <> '')
  SELECT doc_id, CASE WHEN n.h IS NULL THEN 'drop' WHEN n.h = o.h THEN 'reuse' ELSE 'process' END AS action FROM n FULL JOIN o USING (doc_id)""")
def n7_incremental(spark, sf_dir):
    """The labelled documents as first processed against all documents that hold text, squeezed."""
    docs = _DOCS(spark, sf_dir)
    old = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.withColumn("text", squeezed(F.col("text"))).where("text <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    return N.changed(old, new, "doc_id", "h")


@_query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0)
  SELECT doc_id, CASE WHEN n.h IS NULL THEN 'drop' WHEN n.h = o.h THEN 'reuse' ELSE 'process' END AS action FROM n FULL JOIN o USING (doc_id)""")
def n7_every_document(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 5 = 0 OR doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return N.changed(old, new, "doc_id", "h")


@_query("SELECT conv_id, string_agg(v, '|' ORDER BY place, v) AS kept FROM (SELECT conv_id, trim(role) AS v, min(turn) AS place FROM conversations WHERE trim(role) <> '' GROUP BY ALL) GROUP BY conv_id")
def b14_kept_order(spark, sf_dir):
    return C.kept_order(_TURNS(spark, sf_dir), "conv_id", "turn", "role")


@_query("""SELECT CAST(o_custkey AS BIGINT) AS o_custkey, source, target FROM (SELECT o_custkey, o_orderkey AS source, lead(o_orderkey) OVER w AS target, o_orderpriority AS d, lead(o_orderpriority) OVER w AS e FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE d <> e""")
def e21_group_chain(spark, sf_dir):
    return G.group_chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")


@_query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS parent, conv_id || ':' || turn AS node, conv_id, turn FROM conversations)
  SELECT node, parent, lag(node) OVER w AS previous, lead(node) OVER w AS next, 0 AS n_children FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  UNION ALL SELECT parent, NULL, NULL, NULL, count(*) FROM t GROUP BY parent""")
def f1_neighbours(spark, sf_dir):
    turns = _TURNS(spark, sf_dir).select(F.col("conv_id").cast("string").alias("parent"), F.concat_ws(":", "conv_id", "turn").alias("node"), "turn")
    return G.neighbours(G.ordered_children(turns, "parent", "node", "turn"))


@_query("SELECT source, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS spread FROM (SELECT source, lang, avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END) AS r FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY source")
def k9_round_rates(spark, sf_dir):
    rows = _DOCS(spark, sf_dir).select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return K.round_rates(rows, "source", "lang", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality") == 1, 0.5).otherwise(0.0))


@_query("SELECT o_orderkey, n, round((o_totalprice + own) / n, 6) AS per_question FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity) AS own FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)")
def k15_amortised(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return K.amortised(table(spark, sf_dir, "orders"), items, "o_orderkey", "o_totalprice", "l_quantity")


@_query("""SELECT 'all' AS dimension, 'all' AS level, count(n_chars) AS n, round(avg(n_chars), 6) AS mean FROM documents
  UNION ALL SELECT 'source', source, count(n_chars), round(avg(n_chars), 6) FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(n_chars), round(avg(n_chars), 6) FROM documents GROUP BY lang""")
def l2_breakdown(spark, sf_dir):
    return K.breakdown(_DOCS(spark, sf_dir), ["source", "lang"], "n_chars")


@_query("SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS failed, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing FROM events GROUP BY user_id")
def l3_rates(spark, sf_dir):
    return A.rates(_EVENTS(spark, sf_dir), "user_id", failed=F.col("event_type") == "error", missing=F.col("value").isNull())


@_query("SELECT count(d) AS n_strata, round(avg(d), 9) AS difference FROM (SELECT avg(quality - toxic) AS d FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def l8_macro_difference(spark, sf_dir):
    return K.macro_difference(_DOCS(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id"), "source", "quality", "toxic")


@_query("""WITH m AS (SELECT lang, source AS best, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL),
  r AS (SELECT *, round(mean - lead(mean) OVER w, 6) AS lead, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY lang ORDER BY mean DESC, best)) SELECT lang, best, mean, lead FROM r WHERE rn = 1""")
def l10_strongest(spark, sf_dir):
    return K.strongest(_DOCS(spark, sf_dir), "lang", "source", "n_chars")


@_query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_ids, CASE WHEN count(*) <> count(DISTINCT doc_id) THEN 'repeated' WHEN count(*) < 30 THEN 'short' ELSE 'ok' END AS verdict FROM documents GROUP BY source")
def m1_protocol(spark, sf_dir):
    return A.protocol(_DOCS(spark, sf_dir), "source", "doc_id", 30)


@_query("""WITH x AS (SELECT event_type, user_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events), s AS (SELECT event_type, user_id, CAST(sum(d) AS BIGINT) AS d FROM x GROUP BY ALL)
  SELECT event_type, user_id, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d) AS surplus FROM s WHERE d <> 0""")
def m3_multiset_difference(spark, sf_dir):
    rows = _EVENTS(spark, sf_dir)
    return A.multiset_difference(rows.where("event_id % 2 = 0").select("event_type", "user_id"), rows.where("event_id % 2 <> 0").select("event_type", "user_id"))


@_query("SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def m4_dangling(spark, sf_dir):
    return A.dangling(_DOCS(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@_query("SELECT conv_id, count(*) AS n, max(turn) AS last, count(*) = count(DISTINCT turn) AND max(turn) - min(turn) + 1 = count(*) AS closed FROM conversations GROUP BY conv_id")
def m10_ledger(spark, sf_dir):
    return A.ledger(_TURNS(spark, sf_dir), "conv_id", "turn")


@_query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(source), '')) AS value FROM documents")
def b1_first_text(spark, sf_dir):
    return _DOCS(spark, sf_dir).select("doc_id", C.first_text(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")), F.col("source")).alias("value"))


@_query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 300 OFFSET 50)")
def c3_first_ids(spark, sf_dir):
    return C.first_ids(_DOCS(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", 300, 50)


@_query("""SELECT conv_id, turn, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, 1, strpos(text, '. ') - 1) ELSE text END AS head, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, strpos(text, '. ') + 2) ELSE '' END AS rest FROM conversations""")
def d7_split_at_marker(spark, sf_dir):
    head, rest = D.split_at_marker(F.col("text"), ". ")
    return _TURNS(spark, sf_dir).select("conv_id", "turn", head.alias("head"), rest.alias("rest"))


@_query("""SELECT conv_id || ':' || role AS source, conv_id || ':' || turn AS target, 'SPOKE' AS edge_type FROM conversations UNION ALL
  SELECT * FROM (SELECT lag(conv_id || ':' || turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS source, conv_id || ':' || turn AS target, 'NEXT' AS edge_type FROM conversations) WHERE source IS NOT NULL""")
def e6_timeline(spark, sf_dir):
    return G.timeline(_TURNS(spark, sf_dir), "conv_id", "role", "turn")


@_query(f"""WITH t AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {_TOKEN}) AS t FROM documents), s AS (SELECT doc_id, source, unnest(range(0, len(t), 512)) // 512 AS w FROM t)
  SELECT DISTINCT source, CAST(doc_id AS VARCHAR) AS target, 'CATEGORY' AS edge_type FROM s UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':' || w, 'CHUNK' FROM s""")
def e8_category_tree(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    return G.category_tree(D.token_windows(docs, 512).select("doc_id", "window").join(docs.select("doc_id", "source"), "doc_id"), "source", "doc_id", "window")


@_query("""SELECT * FROM (SELECT regexp_replace(lower(CAST(o_custkey AS VARCHAR)), '[^\\pL\\pN]', '', 'g') AS source, o_orderkey AS earlier, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders WHERE o_orderdate IS NOT NULL) WHERE later IS NOT NULL""")
def e11_temporal_chain(spark, sf_dir):
    return G.temporal_chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@_query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL),
  t AS (SELECT user_id, max(value) AS best, round(avg(value), 6) AS mean_top FROM r WHERE r <= 3 GROUP BY user_id) SELECT *, round(best + 0.2 * mean_top, 6) AS total FROM t""")
def g15_group_rank(spark, sf_dir):
    return R.group_rank(_EVENTS(spark, sf_dir), "user_id", "event_id", "value")


@_query("""SELECT DISTINCT p.conv_id, p.turn, i.turn AS origin FROM conversations p JOIN conversations i ON p.conv_id = i.conv_id AND p.turn BETWEEN i.turn + 2 AND i.turn + 4 WHERE i.role = 'user'""")
def g21_scheduled(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    return R.scheduled(turns.where("role = 'user'"), turns, "conv_id", "turn", 2, 4)


@_query("""WITH d AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS digest FROM documents), j AS (SELECT l.doc_id, l.quality, CASE WHEN l.doc_id % 5 = 0 THEN 'old' ELSE sha256(coalesce(d.text, '')) END AS digest FROM labels l JOIN documents d USING (doc_id)),
  s AS (SELECT d.lang, quality, j.digest = d.digest AS fresh FROM j JOIN d USING (doc_id))
  SELECT lang, count(*) FILTER (fresh) AS n, count(*) FILTER (NOT fresh) AS n_stale, round(avg(quality) FILTER (fresh), 6) AS accuracy FROM s GROUP BY ROLLUP (lang)""")
def k10_judged(spark, sf_dir):
    docs = _DOCS(spark, sf_dir).select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    judgments = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return K.judged(judgments, docs, "doc_id", "digest", "lang", "quality")


@_query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS n_progress, round(count(*) FILTER (value > 90) / count(*), 6) AS rate, round(sum(value) / nullif(count(*) FILTER (value > 90), 0), 4) AS unit_cost FROM events GROUP BY event_type""")
def k16_unit_costs(spark, sf_dir):
    return K.unit_costs(_EVENTS(spark, sf_dir), "event_type", "value", F.col("value") > 90)


@_query("""WITH m AS (SELECT user_id, event_type, avg(value) AS mean FROM events GROUP BY ALL)
  SELECT m.user_id, m.event_type, round(m.mean, 6) AS mean, round(m.mean - b.mean, 6) AS delta FROM m LEFT JOIN (SELECT user_id, mean FROM m WHERE event_type = 'purchase') b USING (user_id)""")
def l11_deltas(spark, sf_dir):
    return K.deltas(_EVENTS(spark, sf_dir), "user_id", "event_type", "value", "purchase")


@_query("""WITH e AS (SELECT DISTINCT lang, doc_id FROM documents), f AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE lang END AS lang, doc_id FROM documents SEMI JOIN labels USING (doc_id)),
  x AS (SELECT lang, doc_id, e.doc_id IS NOT NULL AS e, f.doc_id IS NOT NULL AS f FROM e FULL JOIN f USING (lang, doc_id))
  SELECT lang, count(*) FILTER (e) AS n_expected, count(*) FILTER (f) AS n_found, count(*) FILTER (e AND NOT f) AS n_missing, count(*) FILTER (f AND NOT e) AS n_extra, count(*) FILTER (e <> f) = 0 AS complete FROM x GROUP BY lang""")
def m2_reconciled(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    found = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("lang")))
    return A.reconciled(docs, found, "doc_id", "lang")


@_query("""SELECT doc_id // 64 AS batch, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY batch""")
def n8_batch_ledger(spark, sf_dir):
    return N.batch_ledger(_DOCS(spark, sf_dir), "doc_id", 64, "text")
