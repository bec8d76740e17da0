"""Queries of answer scores, resampling statistics, usage tables and record audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import answers as A
from ..operators import audits as U
from ..operators import scoring as K
from ..operators import state as N
from ..sources.records import table
from .registry import _DOCS, _EVENTS, _TURNS, _WORD, _pairs, _plain, _query

_PAIRS = """r AS (SELECT * FROM (SELECT conv_id || ':' || turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations) WHERE gold IS NOT NULL)"""
_W = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), {_WORD})"


@_plain
def k1_best_of_answers(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    answers = F.array_compact(F.array(F.lead("text").over(w), F.lead("text", 2).over(w)))
    rows = _TURNS(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", answers.alias("answers"))
    return A.best_of_answers(rows, "id", "text", "answers")


def _ngrams_sql(w: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


def _f_sql(a: str, b: str) -> str:
    return f"round(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST(2 * len(list_intersect({a}, {b})) AS DOUBLE) / greatest(len({a}) + len({b}), 1) END, 9)"


@_query(f"""WITH {_PAIRS}, w AS (SELECT id, {_W("text")} AS p, {_W("gold")} AS g FROM r), n AS (SELECT id, {_ngrams_sql("p", 1)} AS p1, {_ngrams_sql("g", 1)} AS g1, {_ngrams_sql("p", 2)} AS p2, {_ngrams_sql("g", 2)} AS g2 FROM w)
  SELECT id, CAST({_f_sql("p1", "g1")} AS DOUBLE) AS rouge_1, CAST({_f_sql("p2", "g2")} AS DOUBLE) AS rouge_2 FROM n""")
def k2_rouge_n(spark, sf_dir):
    return A.rouge_n(_pairs(spark, sf_dir), "id", "text", "gold")


_FACTS = f"""{_PAIRS}, p AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM r),
  g AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(gold, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM r),
  pn AS (SELECT *, row_number() OVER () AS i FROM p), gn AS (SELECT *, row_number() OVER () AS j FROM g)"""
_ROUNDED = "CAST(round({}, 9) AS DOUBLE)"


@_query(f"""WITH {_FACTS}, pw AS (SELECT id, i, unnest({_W("s")}) AS w FROM pn), gw AS (SELECT id, j, unnest({_W("s")}) AS w FROM gn), pc AS (SELECT id, i, w, count(*) AS n FROM pw GROUP BY ALL), gc AS (SELECT id, j, w, count(*) AS n FROM gw GROUP BY ALL),
  o AS (SELECT pc.id, i, j, sum(least(pc.n, gc.n)) AS same FROM pc JOIN gc ON pc.id = gc.id AND pc.w = gc.w GROUP BY ALL), ps AS (SELECT id, i, len({_W("s")}) AS n FROM pn), gs AS (SELECT id, j, len({_W("s")}) AS n FROM gn),
  m AS (SELECT ps.id, i, j FROM ps JOIN gs USING (id) LEFT JOIN o USING (id, i, j) WHERE CASE WHEN ps.n + gs.n = 0 THEN 1.0 ELSE round(2.0 * coalesce(same, 0) / (ps.n + gs.n), 9) END >= 0.5),
  a AS (SELECT id, count(*) AS np, count(*) FILTER (i IN (SELECT i FROM m)) AS hp FROM pn GROUP BY id), b AS (SELECT id, count(*) AS ng, count(*) FILTER (j IN (SELECT j FROM m)) AS hg FROM gn GROUP BY id)
  SELECT id, {_ROUNDED.format("CASE WHEN np > 0 THEN hp / np WHEN ng IS NULL THEN 1.0 ELSE 0.0 END")} AS precision, {_ROUNDED.format("CASE WHEN ng > 0 THEN hg / ng WHEN np IS NULL THEN 1.0 ELSE 0.0 END")} AS recall FROM r LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def k3_fact_alignment(spark, sf_dir):
    return A.fact_alignment(_pairs(spark, sf_dir), "id", "text", "gold")


_TERMS4 = f"list_distinct(list_filter({_W('s')}, lambda w: length(w) > 3))"


@_query(f"""WITH {_FACTS}, pt AS (SELECT id, i, lower(s) AS s, {_TERMS4} AS t FROM pn), gt AS (SELECT id, j, lower(s) AS s, {_TERMS4} AS t FROM gn),
  m AS (SELECT p.id, i, j FROM pt p JOIN gt g ON p.id = g.id WHERE (length(p.s) >= 24 AND contains(g.s, p.s)) OR (length(g.s) >= 24 AND contains(p.s, g.s))
    OR (len(list_intersect(p.t, g.t)) > 0 AND (len(list_intersect(p.t, g.t)) >= 0.35 * len(g.t) OR len(list_intersect(p.t, g.t)) >= 0.6 * len(p.t)))),
  a AS (SELECT id, count(*) AS np, count(*) FILTER (i IN (SELECT i FROM m)) AS hp FROM pn GROUP BY id), b AS (SELECT id, count(*) AS ng, count(*) FILTER (j IN (SELECT j FROM m)) AS hg FROM gn GROUP BY id)
  SELECT id, {_ROUNDED.format("CASE WHEN ng IS NULL THEN 1.0 WHEN np IS NULL THEN 0.0 ELSE hp / np END")} AS precision, {_ROUNDED.format("CASE WHEN ng IS NULL THEN 1.0 ELSE hg / ng END")} AS recall FROM r LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def k4_evidence_match(spark, sf_dir):
    return A.evidence_match(_pairs(spark, sf_dir), "id", "text", "gold")


@_plain
def k5_order_accuracy(spark, sf_dir):
    """Each user's first 12 events against the 12 after them."""
    placed = _EVENTS(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("p <= 24")
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("p", "event_type")))), lambda s: s["event_type"])
    rows = placed.groupBy("user_id").agg(part(F.col("p") <= 12).alias("actions"), part(F.col("p") > 12).alias("gold"))
    return A.sequence_order(rows, "user_id", "actions", "gold")


@_query(f"""WITH {_PAIRS}, w AS (SELECT id, {_W("text")} AS p, {_W("gold")} AS g, upper(regexp_extract(coalesce(text, ''), '\\(?([A-Da-d])\\)', 1)) AS letter FROM r)
  SELECT id, CAST(list_has_any(p, g) AS INTEGER) AS any_shared, CAST(array_to_string(p, ' ') = array_to_string(g, ' ') AS INTEGER) AS exact, letter FROM w""")
def k6_document_qa(spark, sf_dir):
    w = _pairs(spark, sf_dir).select("id", words(F.col("text")).alias("p"), words(F.col("gold")).alias("g"), F.upper(F.regexp_extract(F.coalesce("text", F.lit("")), r"\(?([A-Da-d])\)", 1)).alias("letter"))
    shared = F.coalesce(F.arrays_overlap("p", "g"), F.lit(False))
    return w.select("id", shared.cast("int").alias("any_shared"), (F.array_join("p", " ") == F.array_join("g", " ")).cast("int").alias("exact"), "letter")


_NAMES = ["signup", "view", "purchase", "error", "click"]


@_query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS field, CASE event_id % 3 WHEN 1 THEN 'tool=' || event_type ELSE 'did a ' || event_type || ' now' END AS said, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS gold FROM events),
  c AS (SELECT event_id, gold, coalesce(field, nullif(regexp_extract(said, 'tool=([A-Za-z_]+)', 1), ''), CASE WHEN len(list_intersect({_W("said")}, {_NAMES})) = 1 THEN list_intersect({_W("said")}, {_NAMES})[1] END) AS chosen FROM e)
  SELECT event_id, chosen, CASE WHEN gold IS NOT NULL THEN CAST(coalesce(chosen = gold, false) AS INTEGER) END AS correct FROM c""")
def k8_tool_choice(spark, sf_dir):
    gold = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    said = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("tool="), "event_type")).otherwise(F.concat(F.lit("did a "), "event_type", F.lit(" now")))
    rows = _EVENTS(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("field"), said.alias("said"), gold.alias("gold"))
    return A.tool_choice(rows, "event_id", "field", "said", "gold", _NAMES)


@_query("""WITH r AS (SELECT source, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'win' WHEN quality = toxic THEN 'tie' ELSE 'lose' END AS verdict FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT source, avg(CASE WHEN verdict = 'win' THEN 1.0 ELSE 0 END) AS win, avg(CASE WHEN verdict = 'tie' THEN 1.0 ELSE 0 END) AS tie, avg(CASE WHEN verdict = 'lose' THEN 1.0 ELSE 0 END) AS lose FROM r GROUP BY source)
  SELECT source, round(win, 9) AS win, round(tie, 9) AS tie, round(lose, 9) AS lose FROM s UNION ALL SELECT 'macro', round(avg(win), 9), round(avg(tie), 9), round(avg(lose), 9) FROM s""")
def k9_win_tie_lose(spark, sf_dir):
    rows = _DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "win").when(F.col("quality") == F.col("toxic"), "tie").otherwise("lose")
    rate = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)).alias(v)
    by = rows.withColumn("verdict", verdict).groupBy("source").agg(rate("win"), rate("tie"), rate("lose"))
    out = by.unionByName(by.agg(*[F.avg(v).alias(v) for v in ("win", "tie", "lose")]).withColumn("source", F.lit("macro")))
    return out.select("source", *[F.round(v, 9).alias(v) for v in ("win", "tie", "lose")])


@_query("""WITH e AS (SELECT source, quality AS direct, CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS transitive, CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END AS conflict FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT source, count(*) AS n, sum(greatest(direct, transitive)) AS hit, sum(conflict) AS conflicts FROM e GROUP BY source)
  SELECT round(sum(hit) / sum(n), 9) AS micro, round(avg(hit / n), 9) AS macro, CAST(sum(conflicts) AS BIGINT) AS conflicts, count(*) AS n_groups FROM s""")
def k12_evidence_recall(spark, sf_dir):
    rows = _DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    transitive = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).otherwise(0)
    conflict = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).otherwise(0)
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.greatest("quality", transitive)).alias("hit"), F.sum(conflict).alias("c"))
    micro, macro = F.sum("hit") / F.sum("n"), F.avg(F.col("hit") / F.col("n"))
    return by.agg(F.round(micro, 9).alias("micro"), F.round(macro, 9).alias("macro"), F.sum("c").alias("conflicts"), F.count("*").alias("n_groups"))


@_query("""WITH d AS (SELECT lang, sum(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]', '', 'g'))) AS chars, count(*) AS n_docs FROM documents GROUP BY lang), t AS (SELECT lang, count(DISTINCT doc_id) AS found FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang)
  SELECT lang, n_docs, coalesce(found, 0) AS found, round(10000.0 * coalesce(found, 0) / nullif(chars, 0), 9) AS per_10000 FROM d LEFT JOIN t USING (lang)""")
def k13_density(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]", ""))
    size = docs.groupBy("lang").agg(F.sum(chars).alias("chars"), F.count("*").alias("n_docs"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    found = docs.join(toxic, "doc_id", "left_semi").groupBy("lang").agg(F.count_distinct("doc_id").alias("found"))
    n = F.coalesce("found", F.lit(0))
    return size.join(found, "lang", "left").select("lang", "n_docs", n.alias("found"), F.round(10000.0 * n / F.nullif("chars", F.lit(0)), 9).alias("per_10000"))


@_query("""SELECT doc_id || ':' || metric AS item, doc_id, metric, CAST(value AS DOUBLE) AS value, CASE WHEN value = 1 THEN 'met' ELSE 'not met' END AS reason FROM (UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME metric VALUE value)""")
def k17_metric_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "metric", "value").where("value is not null")
    reason = F.when(F.col("value") == 1, "met").otherwise("not met")
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), "metric").alias("item"), "doc_id", "metric", F.col("value").cast("double").alias("value"), reason.alias("reason"))


def _bootstrap_sql(units: str, by: str, seed: int, samples: int) -> str:
    digest = f"concat_ws(':', {seed}, b, replicate, i)"
    lo, hi = int(0.025 * (samples - 1)) + 1, int(0.975 * (samples - 1)) + 1
    return f"""WITH u AS ({units}), p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY b) AS n FROM u),
  d AS (SELECT b, replicate, CAST('0x' || substr(md5({digest}), 1, 8) AS BIGINT) % n AS i FROM (SELECT b, i, n, unnest(range({samples})) AS replicate FROM p)),
  m AS (SELECT d.b, replicate, round(sum(s) / sum(c), 9) AS m FROM d JOIN p ON p.b = d.b AND p.i = d.i GROUP BY ALL), o AS (SELECT b, list(m ORDER BY m) AS ms FROM m GROUP BY b),
  a AS (SELECT b, count(*) AS n_clusters, round(sum(s) / sum(c), 9) AS mean FROM u GROUP BY b)
  SELECT {by} n_clusters, mean, ms[{lo}] AS low, ms[{hi}] AS high FROM a JOIN o USING (b)"""


@_query(_bootstrap_sql("SELECT 'all' AS b, source AS k, sum(n_chars) AS s, count(n_chars) AS c FROM documents WHERE n_chars IS NOT NULL GROUP BY source", "", 13, 200))
def l4_cluster_bootstrap(spark, sf_dir):
    return A.cluster_bootstrap(_DOCS(spark, sf_dir), "source", "n_chars", 200, 13)


@_query(_bootstrap_sql("SELECT lang AS b, source AS k, sum(quality - toxic) AS s, count(*) AS c FROM labels JOIN documents USING (doc_id) WHERE quality - toxic IS NOT NULL GROUP BY ALL", "b AS lang,", 20260801, 100))
def l8_bootstrap_by_stratum(spark, sf_dir):
    rows = _DOCS(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumn("gap", F.col("quality") - F.col("toxic")), "doc_id")
    return A.cluster_bootstrap(rows, "source", "gap", 100, 20260801, "lang")


@_query("""WITH d AS (SELECT k, round(avg(quality) - avg(toxic), 9) AS d, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT doc_id % 10 AS k, quality, toxic FROM labels) GROUP BY k), n AS (SELECT count(*) AS n, round(sum(d), 6) AS obs, round(avg(d), 9) AS mean FROM d),
  m AS (SELECT unnest(range(0, CAST(pow(2, (SELECT n FROM n)) AS BIGINT))) AS m), s AS (SELECT m, round(sum(CASE WHEN (m >> i) % 2 = 1 THEN -d ELSE d END), 6) AS s FROM m, d GROUP BY m)
  SELECT n, mean, round(avg(CASE WHEN abs(s) >= abs(obs) THEN 1.0 ELSE 0.0 END), 9) AS p FROM s, n GROUP BY n, mean""")
def l5_sign_flips(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).alias("k")).agg((F.avg("quality") - F.avg("toxic")).alias("d"))
    return A.sign_flip_test(rows, "k", "d")


_SIGNED = "CASE WHEN (CAST('0x' || substr(md5(concat_ws(':', 17, k, r // 128)), CAST(r % 128 // 4 + 1 AS INTEGER), 1) AS INTEGER) >> CAST(3 - r % 4 AS INTEGER)) % 2 = 1 THEN -v ELSE v END"


@_query(f"""WITH d AS (SELECT doc_id AS k, round((doc_id % 7 - 3) * (quality + 0.1), 9) AS d FROM labels WHERE quality IS NOT NULL), x AS (SELECT k, d, CAST(round(d * 1e9) AS BIGINT) AS v FROM d), r AS (SELECT unnest(range(4096)) AS r),
  n AS (SELECT count(*) AS n, round(avg(d), 9) AS mean, sum(v) AS obs FROM x), s AS (SELECT r, sum({_SIGNED}) AS s FROM x, r GROUP BY r)
  SELECT n, mean, round(avg(CASE WHEN abs(s) >= abs(obs) THEN 1.0 ELSE 0.0 END), 9) AS p FROM s, n GROUP BY n, mean""")
def l5_sampled_flips(spark, sf_dir):
    """A pair for each labelled document: far more than the exact test takes."""
    rows = table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") % 7 - 3) * (F.col("quality") + 0.1)).alias("d"))
    return A.sign_flip_test(rows, "doc_id", "d")


_ACTIVITY = """x AS (SELECT *, count(*) OVER w AS refs, max(event_id) OVER (PARTITION BY user_id) - event_id AS age FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT user_id, event_id, (0.45 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + 0.30 * least(1.0, log2(1 + refs) / 3) + 0.25 * least(5, abs(value) / 20) / 5) * pow(2.0, -(age / 1000.0) / 40) AS score FROM x)"""


@_query(f"""WITH {_ACTIVITY}, r AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN round(score, 6) + 0.001 ELSE round(score, 6) END AS recorded, score FROM s)
  SELECT user_id, count(*) AS n, CAST(count(*) FILTER (abs(recorded - score) > 2e-6) AS BIGINT) AS n_off FROM r GROUP BY user_id""")
def m6_recomputed_scores(spark, sf_dir):
    before = Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    used = _EVENTS(spark, sf_dir).withColumn("refs", F.count("*").over(before))
    used = used.withColumn("age", (F.max("event_id").over(Window.partitionBy("user_id")) - F.col("event_id")) / 1000.0)
    weight = 0.45 * F.when(F.col("event_type") == "error", 1).otherwise(0) + 0.30 * F.least(F.lit(1.0), F.log2(1 + F.col("refs")) / 3) + 0.25 * F.least(F.lit(5.0), F.abs("value") / 20) / 5
    scored = used.select("user_id", "event_id", (weight * F.pow(F.lit(2.0), -F.col("age") / 40)).alias("score"))
    recorded = scored.withColumn("recorded", F.round("score", 6) + F.when(F.col("event_id") % 50 == 0, 0.001).otherwise(0.0))
    return U.differing(recorded, "user_id", "recorded", "score", 2e-6)


@_query("""SELECT user_id, count(*) AS n, CAST(count(*) FILTER (k IS NULL OR k >= 90) AS BIGINT) AS n_invalid, CAST(sum(k) AS BIGINT) AS total, min(CASE WHEN k IS NULL OR k >= 90 THEN event_id END) AS first_invalid
  FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def m7_trace_audit(spark, sf_dir):
    rows = _EVENTS(spark, sf_dir).select("user_id", "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    bad = F.col("k").isNull() | (F.col("k") >= 90)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("n_invalid"), F.sum("k").alias("total"), F.min(F.when(bad, F.col("event_id"))).alias("first_invalid"))


@_query("""WITH v AS (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'create' ELSE 'update' END AS op FROM events), a AS (SELECT user_id, op, count(*) AS accepted FROM v GROUP BY ALL),
  r AS (SELECT user_id, 'create' AS op, count(DISTINCT event_type) AS recorded FROM events GROUP BY user_id UNION ALL SELECT user_id, 'update', count(*) - count(DISTINCT event_type) + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END FROM events GROUP BY user_id)
  SELECT user_id, op, coalesce(accepted, 0) AS accepted, coalesce(recorded, 0) AS recorded, coalesce(accepted, 0) = coalesce(recorded, 0) AS closed FROM a FULL JOIN r USING (user_id, op)""")
def m9_writeback(spark, sf_dir):
    events = _EVENTS(spark, sf_dir)
    op = F.when(F.col("version") == 1, "create").otherwise("update")
    accepted = N.versions(events, ["user_id", "event_type"], "event_id", "value").select("user_id", op.alias("op"))
    by = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("c"), F.count("*").alias("n"))
    off = F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)  # ledgers that do not close
    recorded = by.select("user_id", F.explode(F.array(F.struct(F.lit("create").alias("op"), F.col("c").alias("recorded")), F.struct(F.lit("update").alias("op"), (F.col("n") - F.col("c") + off).alias("recorded")))).alias("x")).select("user_id", "x.*")
    return U.writeback(accepted, recorded, ["user_id", "op"])


@_query("""WITH l AS (SELECT o_custkey AS owner, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS step FROM orders)
  SELECT owner, CAST(count(*) AS BIGINT) AS n, min(step) AS first, max(step) AS last, min(step) = 1 AND max(step) = count(DISTINCT step) AS closed FROM l GROUP BY owner""")
def m10_closed_from_one(spark, sf_dir):
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") + F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0)
    return U.closed_from_one(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), step.alias("step")), "owner", "step")


@_query("""WITH o AS (SELECT conv_id, turn, role, split_part(trim(coalesce(text, '')), ' ', 1) AS value, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations),
  a AS (SELECT *, seen IS NOT NULL AND value <> '' AND contains(lower(seen), lower(value)) AS accepted FROM o), v AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS version FROM a WHERE accepted)
  SELECT a.conv_id, a.turn, a.role, a.value, a.accepted, CAST(version AS INTEGER) AS version FROM a LEFT JOIN v ON v.conv_id = a.conv_id AND v.role = a.role AND v.turn = a.turn""")
def n2_grounded_updates(spark, sf_dir):
    value = F.split_part(F.trim(F.coalesce("text", F.lit(""))), F.lit(" "), F.lit(1))
    seen = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return N.grounded_versions(_TURNS(spark, sf_dir).select("conv_id", "turn", "role", value.alias("value"), seen.alias("seen")), "conv_id", "role", "turn", "value", "seen")


@_query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (value IS NULL OR event_type NOT IN ('signup', 'view', 'purchase', 'error', 'click')) AS bad FROM events GROUP BY ALL)
  SELECT user_id, CAST(day AS VARCHAR) AS day, n, CASE WHEN n > 12 THEN 'too many' WHEN kinds < n THEN 'repeated key' WHEN bad > 0 THEN 'invalid' ELSE 'ok' END AS verdict FROM b""")
def n3_batch_validation(spark, sf_dir):
    ok = F.col("value").isNotNull() & F.col("event_type").isin("signup", "view", "purchase", "error", "click")
    rows = _EVENTS(spark, sf_dir).select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", ok.alias("ok"))
    return N.validated_batches(rows, ["user_id", "day"], "event_type", "ok", 12)


@_query("""WITH s AS (SELECT conv_id, turn, turn // 4 AS volume, trim(regexp_extract(coalesce(text, ''), '^[^.!?\\n]*')) AS summary, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
  l AS (SELECT conv_id, volume, arg_max(summary, turn) AS last, max(p) AS until FROM s GROUP BY ALL)
  SELECT a.conv_id, a.turn, lag(a.summary) OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS rolling, (SELECT string_agg(last, '|' ORDER BY volume) FROM l WHERE l.conv_id = a.conv_id AND l.until < a.p AND l.volume < a.volume) AS volumes,
    (SELECT string_agg(summary, '|' ORDER BY p) FROM s b WHERE b.conv_id = a.conv_id AND b.p BETWEEN a.p - 8 AND a.p - 1) AS recent FROM s a""")
def n6_rolling_summaries(spark, sf_dir):
    summary = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.!?\n]*", 0))
    rows = _TURNS(spark, sf_dir).select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("volume"), summary.alias("summary"))
    return N.rolling_summaries(rows, "conv_id", "turn", "volume", "summary", 8)


@_plain
def l7_reliability(spark, sf_dir):
    """Quality against toxicity labels by language."""
    rows = _DOCS(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return K.reliability(rows, "lang", "quality", "toxic")
