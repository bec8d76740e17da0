"""Queries of the adapters: nested and loosely typed records brought to the library's tables, and checks of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adapters as B
from ..operators import retrieval as R
from ..sources.records import table
from .registry import _DOCS, _EVENTS, _FOUND, _TURNS, _query


@_query("""WITH a AS (SELECT *, lower(split_part(trim(max(CASE WHEN turn = 0 THEN coalesce(text, '') END) OVER (PARTITION BY conv_id)), ' ', 2)) AS answer FROM conversations),
  t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND answer <> '' AND contains(lower(text), answer) AND turn > 1 THEN 0 WHEN answer <> '' AND contains(lower(text), answer) THEN 1 WHEN turn = 0 THEN 2 END AS tier FROM a),
  m AS (SELECT *, min(tier) OVER (PARTITION BY conv_id) AS best FROM t WHERE tier IS NOT NULL) SELECT conv_id, turn, tier FROM m WHERE tier = best""")
def b3_tiered_evidence(spark, sf_dir):
    first = F.max(F.when(F.col("turn") == 0, F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id"))
    rows = _TURNS(spark, sf_dir).withColumn("answer", F.lower(F.split_part(F.trim(first), F.lit(" "), F.lit(2))))
    hit = (F.col("answer") != "") & F.contains(F.lower("text"), F.col("answer"))
    return B.tiered_evidence(rows, "conv_id", "turn", [hit & (F.col("role") == "assistant") & (F.col("turn") > 1), hit, F.col("turn") == 0])


@_query("""WITH q AS (SELECT o_custkey AS question, o_orderkey AS trajectory, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders UNION ALL SELECT c_custkey, -c_custkey, 1000000 FROM customer),
  l AS (SELECT question, trajectory, CASE WHEN place = 1000000 THEN count(*) OVER (PARTITION BY question) - 1 ELSE place END AS place FROM q)
  SELECT question, CAST(place AS INTEGER) AS place, trajectory, l_linenumber AS state, CAST(row_number() OVER (PARTITION BY question ORDER BY place, l_linenumber) - 1 AS INTEGER) AS turn, CASE WHEN l_linenumber IS NULL THEN 'missing' ELSE 'ok' END AS verdict
  FROM l LEFT JOIN lineitem ON l_orderkey = trajectory""")
def b4_haystack(spark, sf_dir):
    """Each customer's orders in turn, and at the end an id that no order has."""
    ids = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    none = F.array().cast("array<bigint>")
    asked = table(spark, sf_dir, "customer").select("c_custkey").join(ids, "c_custkey", "left")
    asked = asked.select("c_custkey", F.concat(F.coalesce("ids", none), F.array(-F.col("c_custkey"))).alias("ids"))
    return B.haystack(asked, table(spark, sf_dir, "lineitem"), "c_custkey", "ids", "l_orderkey", "l_linenumber")


@_query("""SELECT user_id, CAST(0 AS INTEGER) AS turn, 'header' AS role, 'Trajectory of ' || count(*) || ' states' AS content FROM events GROUP BY user_id UNION ALL
  SELECT user_id, CAST(row_number() OVER w AS INTEGER), 'state', 'State ' || row_number() OVER w || ': ' || coalesce(event_type, '?') FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def b5_trajectory_messages(spark, sf_dir):
    return B.trajectory_messages(_EVENTS(spark, sf_dir), "user_id", "event_id", "event_type")


@_query("""SELECT conv_id, CAST(turn // 3 + 1 AS INTEGER) AS session, 'day ' || (turn // 3 + 1) AS dated, CAST(row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) - 1 AS INTEGER) AS place, coalesce(text, '') AS content FROM conversations""")
def b6_session_keys(spark, sf_dir):
    number = F.floor(F.col("turn") / 3) + 1
    key = F.concat(F.lit("session_"), number.cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x"))))
    each = _TURNS(spark, sf_dir).groupBy("conv_id", number.alias("n"), key.alias("key")).agg(F.transform(ordered, lambda s: s["x"]).alias("texts"))
    dated = F.struct(F.concat("key", F.lit("_date_time")).alias("key"), F.array(F.concat(F.lit("day "), F.col("n").cast("string"))).alias("value"))
    entries = F.flatten(F.collect_list(F.array(F.struct("key", F.col("texts").alias("value")), dated)))
    return B.session_turns(each.groupBy("conv_id").agg(F.map_from_entries(entries).alias("sessions")), "conv_id", "sessions")


@_query("""WITH s AS (SELECT doc_id, lang, count(*) AS times FROM documents WHERE doc_id % 13 <> 0 GROUP BY ALL), l AS (SELECT doc_id, lang, 1 AS listed FROM documents WHERE doc_id % 17 <> 0),
  b AS (SELECT lang, times, listed FROM s FULL JOIN l USING (doc_id, lang))
  SELECT lang, count(*) FILTER (times IS NOT NULL) AS n, count(*) FILTER (times IS NOT NULL AND listed IS NULL) AS n_unlisted, count(*) FILTER (times > 1) AS n_repeated, count(*) FILTER (times IS NULL) AS n_missing,
    count(*) FILTER (times IS NULL OR listed IS NULL OR times > 1) = 0 AS complete FROM b GROUP BY lang""")
def b7_registry_check(spark, sf_dir):
    """A list that lacks some documents against rows that lack others."""
    docs = _DOCS(spark, sf_dir)
    return B.registry_check(docs.where("doc_id % 13 <> 0"), docs.where("doc_id % 17 <> 0"), "doc_id", "lang")


@_query("""WITH b AS (SELECT item_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.]'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS s FROM benchmark),
  q AS (SELECT item_id, s, unnest(s) AS question, unnest(range(0, len(s))) AS place FROM b WHERE item_id % 8 <> 0) SELECT item_id, CAST(place AS INTEGER) AS place, question, s[CAST(item_id % 5 AS INTEGER) + 1] AS gold FROM q""")
def b8_flattened_questions(spark, sf_dir):
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[.]"), lambda s: F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")), lambda s: s != "")
    kind = F.when(F.col("item_id") % 8 == 0, "null_query").otherwise("inference")
    rows = table(spark, sf_dir, "benchmark").select("item_id", parts.alias("questions"), parts.alias("options"), (F.col("item_id") % 5).alias("label"), kind.alias("kind"))
    return B.flattened_questions(rows, "item_id", "questions", "options", "label", "kind")


_KINDS = [("/de/", "translation"), ("/es/", "summary"), ("feed", "retrieval")]


@_query("""SELECT page_id, CASE WHEN contains(lower(coalesce(url, '')), '/de/') THEN 'translation' WHEN contains(lower(coalesce(url, '')), '/es/') THEN 'summary' WHEN contains(lower(coalesce(url, '')), 'feed') THEN 'retrieval' ELSE 'qa' END AS task FROM pages""")
def b9_task_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", B.first_match(F.col("url"), _KINDS, "qa").alias("task"))


@_query("""SELECT event_id, user_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n_kept, json_extract_string(props, '$.k') AS k FROM events""")
def b10_projection(spark, sf_dir):
    meta = F.map_concat(F.coalesce(F.from_json("props", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("gold"), F.col("event_type")))
    rows = _EVENTS(spark, sf_dir).select("event_id", "user_id", "event_type", meta.alias("meta"))
    seen = B.projected(rows, ["event_id", "user_id"], "meta", ["k", "locale"])
    return seen.select("event_id", "user_id", F.size("meta").alias("n_kept"), F.try_element_at("meta", F.lit("k")).alias("k"))


@_query("""SELECT event_id, 'meta.K' AS path FROM events WHERE event_id % 4 = 0 AND json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'payload.inner.gold' FROM events WHERE event_type = 'error'""")
def b11_leaks(spark, sf_dir):
    key = F.when(F.col("event_id") % 4 == 0, "K").otherwise("fine")
    k = F.get_json_object("props", "$.k")
    inner = F.struct(F.struct(F.when(F.col("event_type") == "error", F.col("value")).alias("gold"), F.col("value").alias("size")).alias("inner"))
    meta = F.map_filter(F.create_map(key, k), lambda _, v: v.isNotNull())
    return B.leaks(_EVENTS(spark, sf_dir).select("event_id", meta.alias("meta"), inner.alias("payload")), "event_id", ["k", "gold"])


@_query("""WITH e AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' END AS speaker, CAST(CAST(ts AS DATE) AS VARCHAR) AS dated, lower(event_type) AS text, event_id - 3 AS d FROM events),
  f AS (SELECT * FROM e WHERE speaker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY speaker, dated, text ORDER BY event_id) = 1), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY event_id) <= 160)
  SELECT event_id, speaker, dated, text, CASE WHEN d IN (SELECT event_id FROM l) THEN d END AS depends_on FROM l""")
def b15_normalised_events(spark, sf_dir):
    who = F.when(F.col("user_id") % 3 == 0, " ANN").when(F.col("user_id") % 3 == 1, "bob ").otherwise("unknown")
    rows = _EVENTS(spark, sf_dir).select("event_id", who.alias("who"), F.to_date("ts").cast("string").alias("day"), F.concat(F.upper("event_type"), F.lit(" ")).alias("said"), (F.col("event_id") - 3).alias("after"))
    speakers = spark.createDataFrame([("Ann",), ("Bob",)], "name string")
    return B.normalised_events(rows, speakers, "event_id", "who", "day", "said", "after")


@_query("""SELECT 'doc:' || doc_id AS episode_id, source AS domain, 'document' AS task, text AS question, CAST(NULL AS VARCHAR) AS answer FROM documents WHERE trim(coalesce(text, '')) <> '' UNION ALL
  SELECT 'item:' || item_id, 'benchmark', 'qa', text, split_part(text, ' ', 1) FROM benchmark WHERE trim(coalesce(text, '')) <> ''""")
def b16_unified_episodes(spark, sf_dir):
    docs = _DOCS(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("episode_id"), F.col("source").alias("domain"), F.lit("document").alias("task"), F.col("text").alias("question"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("episode_id"), F.lit("benchmark").alias("domain"), F.lit("qa").alias("task"), F.col("text").alias("question"), F.split_part("text", F.lit(" "), F.lit(1)).alias("answer"))
    return docs.unionByName(items, allowMissingColumns=True).where("trim(coalesce(question, '')) <> ''")


@_query("""SELECT event_id, event_type AS api_name, CAST(user_id AS BIGINT) AS api_size, 'call ' || event_type AS request, event_id % 10 <> 0 AS parsed FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, NULL, 'call ' || event_type, false FROM events WHERE event_id % 10 = 0""")
def b17_instruction_parts(spark, sf_dir):
    doc = F.format_string("API doc: {'name': '%s', 'size': %d}\nRequest: call %s", "event_type", "user_id", "event_type")
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Request: call "), "event_type")).otherwise(doc)
    parts = B.instruction_parts(_EVENTS(spark, sf_dir).select("event_id", text.alias("text")), "event_id", "text", "name string, size long")
    return parts.select("event_id", F.col("api.name").alias("api_name"), F.col("api.size").alias("api_size"), "request", "parsed")


@_query("""WITH m AS (SELECT item_id * 7 AS doc_id, item_id AS place FROM benchmark UNION ALL SELECT 0, 1000000), s AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM m)
  SELECT place, doc_id, CASE WHEN n IS NULL THEN 'unknown' WHEN nth > 1 THEN 'repeated' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM r LEFT JOIN s USING (doc_id)""")
def c4_by_manifest(spark, sf_dir):
    listed = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), (F.col("item_id") * 7).alias("doc_id"))
    again = spark.range(1).select(F.lit(1_000_000).cast("long").alias("place"), F.col("id").alias("doc_id"))
    return B.by_manifest(_DOCS(spark, sf_dir), listed.union(again), "doc_id")


@_query("""SELECT conv_id, turn, replace(replace(coalesce(text, ''), 'the', 'METHOD_A'), 'and', 'METHOD_B') AS body, sha256(replace(replace(coalesce(text, ''), 'the', 'METHOD_A'), 'and', 'METHOD_B')) AS digest, substr(sha256(role), 1, 8) AS reviewer FROM conversations""")
def j4_anonymised(spark, sf_dir):
    return R.anonymised(_TURNS(spark, sf_dir), ["conv_id", "turn"], "text", "role", {"the": "METHOD_A", "and": "METHOD_B"})


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  c AS (SELECT query, unnest([max(CASE WHEN rank = 2 THEN doc END), -1, max(CASE WHEN rank = 1 THEN doc END), max(CASE WHEN rank = 3 THEN doc END)][1:3]) AS cited FROM r GROUP BY query)
  SELECT c.query, count(*) AS n_cited, count(r.doc) AS n_grounded, count(*) - count(r.doc) AS n_rejected FROM c LEFT JOIN r ON r.query = c.query AND r.doc = c.cited AND rank <= 5 GROUP BY c.query""")
def j3_cited_ids(spark, sf_dir):
    seen = R.term_hits(table(spark, sf_dir, "benchmark"), _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 5)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("doc")))
    cited = seen.groupBy("query").agg(F.array(at(2), F.lit(-1).cast("long"), at(1), at(3)).alias("ids"))
    return R.resolved_ids(cited, seen, "query", "ids", "doc", 3)


@_query("""WITH v AS (SELECT user_id, event_type, event_id, value, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS later FROM events)
  SELECT event_id, CASE WHEN later IS NOT NULL THEN 'superseded' WHEN value IS NULL THEN 'unreleased' WHEN value > 150 THEN 'leaking' END AS reason,
    CASE WHEN later IS NULL AND value IS NOT NULL AND value <= 150 THEN CASE event_type WHEN 'error' THEN 'Problem ' ELSE 'Fact ' END || event_type || ' of ' || user_id END AS body FROM v""")
def i8_safe_projection(spark, sf_dir):
    later = F.lead("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rules = [(F.col("later").isNotNull(), "superseded"), (F.col("value").isNull(), "unreleased"), (F.col("value") > 150, "leaking")]
    body = F.concat(F.when(F.col("event_type") == "error", "Problem ").otherwise("Fact "), "event_type", F.lit(" of "), F.col("user_id").cast("string"))
    return R.safe_texts(_EVENTS(spark, sf_dir).withColumn("later", later), "event_id", body, rules)


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  l AS (SELECT query, string_agg(doc, ',' ORDER BY rank) AS retrieved FROM r WHERE rank <= 5 GROUP BY query), g AS (SELECT query, string_agg(doc, ',' ORDER BY doc) AS gold, count(*) AS n_gold FROM r JOIN labels ON doc = doc_id WHERE rank <= 5 AND quality = 1 GROUP BY query)
  SELECT query, text AS question, retrieved, gold, coalesce(n_gold, 0) AS n_gold FROM l JOIN benchmark ON item_id = query LEFT JOIN g USING (query)""")
def a10_audit_rows(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    hits = R.term_hits(items, _DOCS(spark, sf_dir), "item_id", "doc_id", "text", 5)
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col("doc").cast("string").alias("x")))), lambda s: s["x"]), ",")
    good = hits.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc")), "doc")
    gold = good.groupBy("query").agg(joined("doc").alias("gold"), F.count("*").alias("n_gold"))
    lists = hits.groupBy("query").agg(joined("rank").alias("retrieved"))
    rows = lists.join(items.select(F.col("item_id").alias("query"), F.col("text").alias("question")), "query").join(gold, "query", "left")
    return rows.select("query", "question", "retrieved", "gold", F.coalesce("n_gold", F.lit(0)).alias("n_gold"))
