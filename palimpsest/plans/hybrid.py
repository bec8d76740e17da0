"""Queries of neighbourhood search, channel unions, state views, audits, coverage, dependency recall, rendered contexts and catalogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, terms, tokens
from ..operators import hybrid as H
from ..operators import search as S
from ..operators.components import capped_components
from ..sources.records import table
from .registry import _TOKEN, _TURNS, SQL, _plain, _query, _terms_sql
from .search import _COSINE, _vectors, g1_cosine_top_k
from .walks import f9_context_order


def _documents_of_eight(spark, sf_dir):
    """Vectors by document: eight that follow each other are one."""
    rows = table(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 8))
    return S.vectors(rows, "vec_id", "embedding", "doc")


@_query(f"""WITH u AS (SELECT *, sqrt(list_inner_product(e, e)) AS n, row_number() OVER (PARTITION BY g ORDER BY id) AS p FROM (SELECT vec_id AS id, vec_id // 8 AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
  x AS (SELECT g, unnest(e) / nullif(n, 0) AS x, unnest(range(0, len(e))) AS d FROM u), m AS (SELECT g, d, avg(coalesce(x, 0)) AS x FROM x GROUP BY ALL),
  c AS (SELECT g AS id, list(x ORDER BY d) AS e FROM m GROUP BY g), w AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM c),
  s AS (SELECT a.id AS query, b.id, b.g, b.p, {_COSINE} AS score FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 50 = 0),
  seed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 16),
  l AS (SELECT a.id AS g, b.id AS linked, {_COSINE} AS edge FROM w a JOIN w b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY edge DESC, b.id) <= 2),
  k AS (SELECT query, linked, max(edge) AS edge FROM seed JOIN l USING (g) GROUP BY ALL),
  o AS (SELECT query, id, 'seed' AS origin, 1 - (rank - 1) / 32 AS bonus FROM seed UNION ALL
    SELECT seed.query, s.id, 'neighbour', 0.6 / abs(s.p - seed.p) FROM seed JOIN s ON s.query = seed.query AND s.g = seed.g AND abs(s.p - seed.p) IN (1, 2) UNION ALL
    SELECT query, id, 'linked', greatest(edge, 0) * 0.5 FROM (SELECT s.*, edge FROM k JOIN s ON s.query = k.query AND s.g = linked QUALIFY row_number() OVER (PARTITION BY k.query, linked ORDER BY s.score DESC, s.id) = 1)),
  b AS (SELECT query, id, CAST(bonus AS DOUBLE) AS bonus, origin FROM o QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY CAST(bonus AS DOUBLE) DESC, origin DESC) = 1),
  t AS (SELECT a.id AS query, b.id AS g, {_COSINE} AS score FROM u a JOIN w b ON a.id % 50 = 0),
  f AS (SELECT query, s.id, s.g, origin, round(CAST(0.65 AS DOUBLE) * s.score + CAST(0.20 AS DOUBLE) * t.score + CAST(0.15 AS DOUBLE) * bonus, 9) AS score FROM b JOIN s USING (query, id) JOIN t USING (query, g)),
  y AS (SELECT *, row_number() OVER (PARTITION BY query, g ORDER BY score DESC, id) AS in_group FROM f)
  SELECT query, id, CAST(g AS VARCHAR) AS "group", origin, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place FROM y WHERE in_group <= 3 QUALIFY place <= 10""")
def g4_neighbourhood(spark, sf_dir):
    rows = _documents_of_eight(spark, sf_dir)
    centres = S.centroids(rows)
    links = S.nearest(centres, centres, 2).select(F.col("query").cast("string").alias("group"), F.col("id").cast("string").alias("linked"), F.col("score").alias("edge"))
    return H.neighbourhood_search(rows.where("id % 50 = 0"), rows, links)


@_query(f"""WITH o AS ({SQL["g4_neighbourhood"]}), d AS ({SQL["g1_cosine_top_k"]}),
  p AS (SELECT query, count(*) FILTER (o.place IS NOT NULL AND d.rank IS NOT NULL) AS shared, count(*) AS n FROM o FULL JOIN d USING (query, id) GROUP BY query)
  SELECT 'queries' AS metric, CAST(count(*) AS DOUBLE) AS value FROM p UNION ALL SELECT 'changed', CAST(count(*) FILTER (shared < n) AS DOUBLE) FROM p UNION ALL
  SELECT 'mean_jaccard', round(avg(shared / n), 6) FROM p UNION ALL SELECT 'origin:' || origin, CAST(count(*) AS DOUBLE) FROM o GROUP BY origin""")
def g23_retrieval_audit(spark, sf_dir):
    return H.retrieval_audit(g4_neighbourhood(spark, sf_dir), g1_cosine_top_k(spark, sf_dir))


_COMPACT = r"regexp_replace(lower(coalesce({}, '')), '[ \t\n\r]+', '', 'g')"
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"


def _pairs(spark, sf_dir, window: int):
    """Every turn with the `window` turns before it: cosine of word counts, bigram overlap, gap in turns, equal role."""
    turns = _TURNS(spark, sf_dir)
    found = S.channel_candidates(turns, "conv_id", "turn", "role", "text", window, window, 0.18)
    side = lambda turn, b: turns.select("conv_id", F.col("turn").alias(turn), H.bigrams(F.col("text")).alias(b))
    both = found.join(side("target", "b1"), ["conv_id", "target"]).join(side("source", "b2"), ["conv_id", "source"])
    task = H.bigram_overlap(F.col("b1"), F.col("b2"))
    return both.select("conv_id", "target", "source", F.col("cosine").alias("semantic"), task.alias("task"), (F.col("target") - F.col("source")).alias("gap"), F.col("referenced").alias("same_key"))


@_query(f"""WITH h AS ({SQL["h1_three_channels"].replace("a.p - b.p <= 2 AS", "a.p - b.p <= 8 AS")}), t AS (SELECT conv_id, turn, {_COMPACT.format("text")} AS c FROM conversations), g AS (SELECT conv_id, turn, {_BIGRAMS.format("c")} AS b FROM t),
  f AS (SELECT h.conv_id, target, source, cosine AS semantic, round(coalesce(len(list_intersect(x.b, y.b)) / nullif(least(len(x.b), len(y.b)), 0), 0), 6) AS task, target - source AS gap, coalesce(referenced, false) AS same_key
    FROM h JOIN g x ON x.conv_id = h.conv_id AND x.turn = target JOIN g y ON y.conv_id = h.conv_id AND y.turn = source),
  c AS (SELECT conv_id, target, source, 'Vc' AS channel FROM f WHERE gap <= 2 UNION ALL SELECT conv_id, target, source, 'Vr' FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, target ORDER BY task DESC, source) <= 3 UNION ALL
    SELECT conv_id, target, source, 'Cdep' FROM (SELECT * FROM f WHERE semantic >= 0.35 QUALIFY row_number() OVER (PARTITION BY conv_id, target ORDER BY semantic DESC, source) <= 128) UNION SELECT conv_id, target, source, 'Cdep' FROM f WHERE same_key),
  n AS (SELECT conv_id, target, source, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM c GROUP BY ALL),
  z AS (SELECT n.*, semantic, CASE WHEN same_key THEN CAST(1 AS DOUBLE) ELSE task END AS task, gap, same_key FROM n JOIN f USING (conv_id, target, source)),
  e AS (SELECT *, round(least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) * semantic + CAST(0.3 AS DOUBLE) * task + CAST(0.2 AS DOUBLE) / (1 + gap) + CASE WHEN same_key THEN CAST(0.5 AS DOUBLE) ELSE 0 END), 9) AS fused FROM z)
  SELECT conv_id, target, source, channels, fused, CAST(row_number() OVER (PARTITION BY conv_id, target ORDER BY fused DESC, semantic DESC, task DESC, gap, source) AS INTEGER) AS rank FROM e QUALIFY rank <= 192""")
def h4_union_ranking(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, 8)
    place = lambda c: F.row_number().over(Window.partitionBy("conv_id", "target").orderBy(F.desc(c), "source"))
    near = pairs.where("semantic >= 0.35").withColumn("r", place("semantic")).where("r <= 128").drop("r")
    channels = {"Vc": pairs.where("gap <= 2"), "Vr": pairs.withColumn("r", place("task")).where("r <= 3"), "Cdep": near.unionByName(pairs.where("same_key"))}
    return H.union_ranked(channels, pairs, ["conv_id", "target"], 192)


@_query(f"""WITH RECURSIVE l AS (SELECT conv_id, max(turn) AS last, coalesce(arg_max(text, turn), '') AS source FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id),
  r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, source, list_sort({_terms_sql('text', 6)})[1:3] AS entities, {_COMPACT.format("text")} AS c, {_COMPACT.format("source")} AS cs FROM conversations JOIN l USING (conv_id) WHERE turn < last),
  s AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, {_TOKEN})) AS v, len(list_filter(entities, lambda x: contains(source, x))) > 0 AS hit, {_BIGRAMS.format("c")} AS b, {_BIGRAMS.format("cs")} AS bs FROM r),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hit DESC, round(1 - round(coalesce(len(list_intersect(b, bs)) / nullif(least(len(b), len(bs)), 0), 0), 6), 9), role = 'user' DESC, length(text) % 3 DESC, turn DESC) AS p FROM s),
  f AS (SELECT conv_id, turn, p, v <= 120 AS fits, CASE WHEN v <= 120 THEN v ELSE 0 END AS used, CAST(v <= 120 AS INTEGER) AS n FROM o WHERE p = 1 UNION ALL
    SELECT o.conv_id, o.turn, o.p, f.n < 4 AND f.used + v <= 120, CASE WHEN f.n < 4 AND f.used + v <= 120 THEN f.used + v ELSE f.used END, f.n + CAST(f.n < 4 AND f.used + v <= 120 AS INTEGER) FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p + 1)
  SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM f WHERE fits""")
def i7_state_view(spark, sf_dir):
    """What each conversation's last turn sees of the turns before it."""
    turns = _TURNS(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("seen"))
    rows = turns.join(last, "conv_id").where("turn < last").withColumn("entities", F.slice(F.array_sort(terms(F.col("text"), 6)), 1, 3))
    hit = F.exists("entities", lambda x: F.contains("seen", x))
    rows = rows.withColumn("b1", H.bigrams(F.col("text"))).withColumn("b2", H.bigrams(F.col("seen")))
    return H.state_view(rows, "conv_id", "turn", hit, H.bigram_overlap(F.col("b1"), F.col("b2")), F.col("role") == "user", F.length("text") % 3, F.col("turn"), F.size(tokens(F.col("text"))), 120, 4)


_SQUEEZED = r"trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g'))"
_HEAD = "array_to_string(string_split({}, ' ')[1:{}], ' ')"


@_query(f"""WITH t AS (SELECT conv_id, turn, {_SQUEEZED} AS s FROM conversations), p AS (SELECT *, lead(turn) OVER w AS next, lead(s) OVER w AS after, lag(s) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  e AS (SELECT conv_id, ' ' || s || ' ' AS source, ' ' || after || ' ' AS target FROM p WHERE next IS NOT NULL),
  g AS (SELECT conv_id, turn AS n, {_HEAD.format("s", 3)} AS source, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN {_HEAD.format("after", 2)} ELSE {_HEAD.format("before", 2)} END AS target FROM p WHERE next IS NOT NULL),
  h AS (SELECT conv_id, n FROM g WHERE source <> '' AND EXISTS (SELECT 1 FROM e WHERE e.conv_id = g.conv_id AND contains(e.source, ' ' || g.source || ' ') AND (coalesce(g.target, '') = '' OR contains(e.target, ' ' || g.target || ' ')))),
  c AS (SELECT conv_id, count(*) AS n_gold FROM g GROUP BY conv_id), k AS (SELECT conv_id, count(*) AS n_hit FROM h GROUP BY conv_id)
  SELECT conv_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_hit, 0) AS n_hit, coalesce(CAST(coalesce(n_hit, 0) AS DOUBLE) / n_gold, 1) AS recall, CASE WHEN n_gold IS NULL THEN 'no_gold' ELSE 'literal' END AS basis
  FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id) LEFT JOIN k USING (conv_id)""")
def f11_dependency_recall(spark, sf_dir):
    """Gold pairs are the first words of a turn and of its next turn, or of the one before, which only a repeated phrase can hit."""
    turns = _TURNS(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn", squeezed(F.col("text")).alias("s")).withColumns({"next": F.lead("turn").over(w), "after": F.lead("s").over(w), "before": F.lag("s").over(w)}).where("next is not null")
    head = lambda c, n: F.array_join(F.slice(F.split(c, " "), 1, n), " ")
    target = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, head("after", 2)).otherwise(F.coalesce(head("before", 2), F.lit("")))
    gold = t.select("conv_id", F.col("turn").alias("n"), head("s", 3).alias("source"), target.alias("target"))
    edges = t.select("conv_id", F.col("turn").alias("source"), F.col("next").alias("target"))
    return H.dependency_recall(turns, edges, turns.select("conv_id", F.col("turn").alias("node"), "text"), gold, "conv_id")


def _wanted(spark, sf_dir):
    """What a conversation's later turns should cover: three words of its first turn as scope, the first two words of its second as anchor."""
    turns = _TURNS(spark, sf_dir)
    first = turns.where("turn = 0").select("conv_id", F.posexplode(F.slice(F.array_sort(terms(F.col("text"))), 1, 3)).alias("n", "item")).withColumn("kind", F.lit("scope"))
    head = F.array_join(F.slice(F.split(squeezed(F.col("text")), " "), 1, 2), " ")
    anchor = turns.where("turn = 1").select("conv_id", F.lit(9).alias("n"), head.alias("item"), F.lit("anchor").alias("kind"))
    return first.unionByName(anchor), turns.where("turn > 1").select("conv_id", F.col("turn").alias("node"), "text")


_WANTED = f"""w AS (SELECT conv_id, unnest(range(0, len(i))) AS n, unnest(i) AS item, 'scope' AS kind FROM (SELECT conv_id, list_sort({_terms_sql('text', 2)})[1:3] AS i FROM conversations WHERE turn = 0) UNION ALL
    SELECT conv_id, 9, {_HEAD.format(_SQUEEZED, 2)}, 'anchor' FROM conversations WHERE turn = 1),
  t AS (SELECT conv_id, turn, role, ' ' || {_SQUEEZED} || ' ' AS s FROM conversations),
  l AS (SELECT w.conv_id, CAST(n AS INTEGER) AS n, kind, item, count(turn) AS hits FROM w LEFT JOIN t ON t.conv_id = w.conv_id AND turn > 1 AND item <> '' AND contains(s, ' ' || item || ' ') GROUP BY ALL)"""


@_query(f"WITH {_WANTED} SELECT conv_id, n, kind, item, hits FROM l")
def g18_coverage(spark, sf_dir):
    wanted, texts = _wanted(spark, sf_dir)
    return H.coverage(wanted, texts, "conv_id")


@_query(f"""WITH {_WANTED}, e AS (SELECT conv_id, coalesce(bool_and(hits > 0) FILTER (kind = 'scope'), false) AS scope_complete, coalesce(bool_and(hits > 0) FILTER (kind = 'anchor'), false) AS anchor_complete, count(*) FILTER (kind = 'anchor') AS anchors FROM l GROUP BY conv_id),
  q AS (SELECT conv_id, length(coalesce(text, '')) % 2 = 0 AS needed FROM conversations WHERE turn = 0)
  SELECT conv_id, coalesce(scope_complete, false) AS scope_complete, coalesce(anchor_complete, false) AS anchor_complete, CASE WHEN NOT needed THEN 'not_required' WHEN scope_complete AND (anchor_complete OR anchors = 0) THEN 'complete' ELSE 'partial' END AS status FROM q LEFT JOIN e USING (conv_id)""")
def g18_coverage_status(spark, sf_dir):
    wanted, texts = _wanted(spark, sf_dir)
    needed = _TURNS(spark, sf_dir).where("turn = 0").select("conv_id", (F.length(F.coalesce("text", F.lit(""))) % 2 == 0).alias("needed"))
    return H.coverage_status(H.coverage(wanted, texts, "conv_id"), needed, "conv_id")


@_query(f"""WITH {_WANTED}, o AS (SELECT l.conv_id, 'option' || n AS option, hits, count(turn) FILTER (role = 'assistant') AS acted FROM l LEFT JOIN t ON t.conv_id = l.conv_id AND turn > 1 AND item <> '' AND contains(s, ' ' || item || ' ') GROUP BY l.conv_id, n, kind, item, hits),
  e AS (SELECT conv_id, option, sum(acted) AS n_actions FROM o GROUP BY ALL HAVING bool_and(hits > 0))
  SELECT conv_id, min(option) AS option, CAST(min(n_actions) AS BIGINT) AS n_actions FROM e x WHERE n_actions = (SELECT min(n_actions) FROM e y WHERE y.conv_id = x.conv_id) AND (SELECT count(*) FROM e y WHERE y.conv_id = x.conv_id) >= 2 GROUP BY conv_id HAVING count(*) = 1""")
def g18_least_acted(spark, sf_dir):
    wanted, texts = _wanted(spark, sf_dir)
    acting = texts.join(_TURNS(spark, sf_dir).where("role = 'assistant'").select("conv_id", F.col("turn").alias("node")), ["conv_id", "node"], "left_semi")
    option = F.concat(F.lit("option"), "n").alias("option")
    hits = lambda seen: H.coverage(wanted, seen, "conv_id").select("conv_id", option, "item", "hits")
    return H.least_acted_option(hits(texts), hits(acting), "conv_id")


@_query(f"""WITH p AS ({SQL["f9_context_order"]}), n AS (SELECT conv_id, turn, place, '- ' || turn || ' ' || role || ': ' || substr(coalesce(text, ''), 1, 120) || chr(10) AS line FROM p JOIN conversations USING (conv_id, turn)),
  c AS (SELECT *, 8 + CAST(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY place) AS BIGINT) AS used FROM n), k AS (SELECT *, 400 - used + length(line) AS rest FROM c),
  b AS (SELECT conv_id, string_agg(CASE WHEN used <= 400 THEN line ELSE substr(line, 1, rest - 4) || '...' || chr(10) END, '' ORDER BY place) AS body, coalesce(max(used) FILTER (used <= 400), 8) AS used, count(*) AS n_nodes FROM k WHERE used <= 400 OR rest > 80 GROUP BY conv_id),
  e AS (SELECT x.conv_id, CAST(x.turn AS VARCHAR) AS source, CAST(y.turn AS VARCHAR) AS "end", '- ' || x.turn || ' -MAINLINE-> ' || y.turn || chr(10) AS line FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
  f AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY source, "end") AS BIGINT) AS total FROM e), g AS (SELECT f.conv_id, string_agg(line, '' ORDER BY source, "end") AS tail, count(*) AS n_edges FROM f JOIN b USING (conv_id) WHERE b.used + 11 + total <= 400 GROUP BY f.conv_id)
  SELECT conv_id, substr('Context' || chr(10) || body || CASE WHEN tail IS NULL THEN '' ELSE 'Relations:' || chr(10) || tail END, 1, 400) AS text, n_nodes, coalesce(n_edges, 0) AS n_edges FROM b LEFT JOIN g USING (conv_id)""")
def f13_rendered_context(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    line = F.concat(F.lit("- "), "turn", F.lit(" "), "role", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 120), F.lit("\n"))
    nodes = f9_context_order(spark, sf_dir).join(turns, ["conv_id", "turn"]).select("conv_id", F.col("turn").cast("string").alias("node"), "place", line.alias("line"))
    edges = turns.select("conv_id", F.col("turn").cast("string").alias("source"), (F.col("turn") + 1).cast("string").alias("end"), F.lit("MAINLINE").alias("kind"))
    return H.rendered(nodes, edges, "conv_id", "Context\n", 400)


@_query("""WITH s AS (SELECT s_nationkey AS k, list(s_name ORDER BY s_name) FILTER (s_acctbal >= 0) AS r, list(s_name ORDER BY s_name) FILTER (s_acctbal < 0) AS o FROM supplier GROUP BY ALL),
  a AS (SELECT n_regionkey AS task, n_name AS api, coalesce(r, []) || coalesce(o, []) AS names, len(coalesce(r, [])) AS nr FROM nation LEFT JOIN s ON k = n_nationkey),
  p AS (SELECT task, api, unnest(range(1, len(names) + 1)) AS i, unnest(names) AS name, nr FROM a), q AS (SELECT task, 'api:' || api AS api, 'param:' || api || '.' || i || '.' || name AS param, CASE WHEN i <= nr THEN 'required' ELSE 'optional' END AS kind FROM p)
  SELECT DISTINCT task, 'stage' AS source, 'query' AS target, 'INCLUSION' AS edge_type, '' AS reason FROM a UNION ALL SELECT task, 'stage', 'api:' || api, 'INCLUSION', '' FROM a UNION ALL SELECT task, 'api:' || api, 'query', 'DEPENDENCY', 'available' FROM a UNION ALL
  SELECT task, api, param, 'INCLUSION', '' FROM q UNION ALL SELECT task, param, api, 'DEPENDENCY', kind FROM q""")
def e7_catalogue_graph(spark, sf_dir):
    """Nations as APIs of their region's task; their suppliers are parameters, those with a debt optional."""
    named = lambda rows, name: rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias(name))
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation").withColumn("s_nationkey", F.col("n_nationkey"))
    apis = nations.join(named(suppliers.where("s_acctbal >= 0"), "required"), "s_nationkey", "left").join(named(suppliers.where("s_acctbal < 0"), "optional"), "s_nationkey", "left")
    return H.catalogue_graph(apis.select(F.col("n_regionkey").alias("task"), F.col("n_name").alias("api"), "required", "optional"), "task")


@_query(rf"""WITH c AS (SELECT conv_id, turn, regexp_extract({_SQUEEZED}, '^[a-z]+') AS name, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'other' ELSE role END AS schema FROM conversations WHERE turn < 3 AND NOT (conv_id % 7 = 0 AND turn = 2)),
  r AS (SELECT conv_id, turn, 'name' || turn AS name, role AS schema FROM conversations WHERE turn < 3), p AS (SELECT conv_id, turn, r.name AS r, c.name AS c, r.schema AS rs, c.schema AS cs FROM r FULL JOIN c USING (conv_id, turn)),
  m AS (SELECT conv_id, bool_or(r IS NULL OR c IS NULL) AS miscount, bool_or(rs IS DISTINCT FROM cs) AS misfit FROM p GROUP BY conv_id), a AS (SELECT conv_id, max(n) AS m FROM (SELECT conv_id, c, count(DISTINCT r) AS n FROM p WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY ALL) GROUP BY conv_id),
  n AS (SELECT conv_id, count(*) AS n, string_agg(c, '|' ORDER BY length(c) DESC, c) AS pattern, map_from_entries(list((c, r))) AS names FROM (SELECT conv_id, c, min(r) AS r FROM p WHERE c <> r AND c <> '' GROUP BY ALL) GROUP BY conv_id),
  v AS (SELECT conv_id, CASE WHEN miscount THEN 'count' WHEN misfit THEN 'schema' WHEN m > 1 THEN 'ambiguous' WHEN n > 0 THEN 'renamed' ELSE 'equal' END AS verdict, n, pattern, names FROM m LEFT JOIN a USING (conv_id) LEFT JOIN n USING (conv_id)),
  t AS (SELECT conv_id, turn AS id, {_SQUEEZED} AS text FROM conversations), s AS (SELECT t.*, verdict, n, CASE WHEN verdict = 'renamed' THEN regexp_split_to_array(text, pattern) END AS parts, CASE WHEN verdict = 'renamed' THEN list_transform(regexp_extract_all(text, pattern), lambda x: names[x]) END AS found FROM t LEFT JOIN v USING (conv_id))
  SELECT conv_id, id, CASE WHEN verdict = 'renamed' THEN array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(found[i], '')), '') ELSE text END AS text, CAST(CASE WHEN verdict = 'renamed' THEN n ELSE 0 END AS INTEGER) AS n_names, coalesce(verdict, 'equal') AS verdict FROM s""")
def j5_renamed_by_position(spark, sf_dir):
    """First words of a conversation's first turns as a candidate's names, some with another schema or missing."""
    turns = _TURNS(spark, sf_dir).withColumn("s", squeezed(F.col("text")))
    early = turns.where("turn < 3")
    schema = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "other").otherwise(F.col("role")).alias("schema")
    name = F.regexp_extract("s", "^[a-z]+", 0)
    candidate = early.where("not (conv_id % 7 = 0 and turn = 2)").select("conv_id", F.col("turn").alias("position"), schema, name.alias("name"))
    reference = early.select("conv_id", F.col("turn").alias("position"), F.col("role").alias("schema"), F.concat(F.lit("name"), "turn").alias("name"))
    return H.renamed_by_position(reference, candidate, turns.select("conv_id", F.col("turn").alias("id"), F.col("s").alias("text")), "conv_id")


@_plain
def e19_capped_components(spark, sf_dir):
    """Vectors merged along their five nearest neighbours, strongest first, into classes of at most twelve."""
    rows = _vectors(spark, sf_dir)
    return capped_components(S.undirected(S.nearest(rows, rows, 5), 0.25), 12)
