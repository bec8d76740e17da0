"""Queries of nested records: fields of any kind, histories and sessions, evidence by precedence, histories stored once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as N
from .registry import _DOCS, _TURNS, _query

_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')"


@_query(f"""WITH d AS (SELECT doc_id, lang, source, n_chars, text, {_WORDS} AS w FROM documents)
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(trim(lang), '') WHEN 1 THEN CASE WHEN len(w) > 0 THEN array_to_string(w[1:5], ' ') END WHEN 2 THEN to_json({{'source': source, 'n_chars': n_chars}})::VARCHAR END AS value FROM d""")
def b1_first_field(spark, sf_dir):
    """By the id a text, an array or a struct is what is not empty."""
    at = F.col("doc_id") % 4
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    rows = _DOCS(spark, sf_dir).select(
        "doc_id", F.when(at == 0, F.col("lang")).otherwise("  ").alias("answer"), F.when(at == 1, words).otherwise(F.array().cast("array<string>")).alias("answers"),
        F.when(at == 2, F.struct("source", "n_chars")).alias("target"),
    )
    return rows.select("doc_id", N.first_field(rows.schema, F.col, ["answer", "absent", "answers", "target"]).alias("value"))


def _records(spark, sf_dir):
    """Twelve turns of a conversation to a record, in sessions of three."""
    turn = F.col("turn")
    cut = _TURNS(spark, sf_dir).where("conv_id is not null and turn is not null").select((F.col("conv_id") * 100000 + F.floor(turn / 12)).alias("record"), F.floor(turn % 12 / 3).alias("s"), "turn", "role", "text")
    marked = cut.withColumn("has_answer", (F.col("turn") % 5 == 3) & (F.col("record") % 3 == 0))
    message = F.struct("turn", "role", F.col("text").alias("content"), "has_answer")
    sessions = marked.groupBy("record", "s").agg(F.array_sort(F.collect_list(message)).alias("session"))
    whole = F.array_sort(F.collect_list(F.struct("s", "session")))
    return sessions.groupBy("record").agg(F.transform(whole, lambda x: x["session"]).alias("haystack_sessions"), F.transform(whole, lambda x: F.concat(F.lit("s"), x["s"].cast("string"))).alias("haystack_session_ids"))


_CUT = """c AS (SELECT conv_id * 100000 + turn // 12 AS record, turn % 12 // 3 AS s, turn, role, nullif(trim(text), '') AS content, turn % 5 = 3 AND (conv_id * 100000 + turn // 12) % 3 = 0 AS marked FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  n AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY record ORDER BY s) AS INTEGER) AS session FROM c)"""


@_query(f"""WITH {_CUT} SELECT record, session, CAST(row_number() OVER (PARTITION BY record ORDER BY session, turn) AS INTEGER) AS turn_index, coalesce(nullif(role, ''), 'user') AS role, content FROM n WHERE content IS NOT NULL""")
def b2_session_messages(spark, sf_dir):
    return N.session_messages(_records(spark, sf_dir), "record", "haystack_sessions")


@_query("""WITH p AS (SELECT doc_id, lang, text, string_split(coalesce(text, ''), '.') AS parts FROM documents), m AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS turn_index, unnest(parts) AS content FROM p WHERE doc_id % 3 = 0)
  SELECT doc_id, CAST(turn_index AS INTEGER) AS turn_index, 'user' AS role, trim(content) AS content FROM m WHERE trim(content) <> '' UNION ALL
  SELECT doc_id, 1, 'user', trim(text) FROM p WHERE doc_id % 3 = 1 AND trim(text) <> '' UNION ALL
  SELECT doc_id, 1, 'user', trim(lang) FROM p WHERE trim(lang) <> '' AND (doc_id % 3 = 2 OR (doc_id % 3 = 1 AND trim(coalesce(text, '')) = '') OR (doc_id % 3 = 0 AND len(list_filter(parts, lambda x: trim(x) <> '')) = 0))""")
def b2_histories(spark, sf_dir):
    """Histories as arrays, as one text, and absent: then the language stands in."""
    at = F.col("doc_id") % 3
    parts = F.when(at == 0, F.split(F.coalesce("text", F.lit("")), "[.]"))
    rows = _DOCS(spark, sf_dir).select("doc_id", parts.alias("messages"), F.when(at == 1, F.col("text")).alias("history"), F.col("lang").alias("context"))
    return N.history(rows, "doc_id", ["messages", "history"], ["context"])


@_query(f"""WITH {_CUT}, a AS (SELECT record, lower(split_part(max(CASE WHEN p = 1 THEN content END), ' ', 2)) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY turn) AS p FROM n WHERE content IS NOT NULL) GROUP BY record),
  t AS (SELECT n.*, coalesce(answer, '') AS answer, answer <> '' AND contains(lower(content), answer) AS hit, n.s = 1 AND n.record % 2 = 0 AS near FROM n LEFT JOIN a USING (record) WHERE content IS NOT NULL),
  h AS (SELECT *, bool_or(hit) OVER (PARTITION BY record, session) AS any_hit FROM t),
  x AS (SELECT record, 0 AS tier, 0 AS session, 0 AS turn, 'given ' || record AS content FROM (SELECT DISTINCT record FROM n) WHERE record % 7 = 0 UNION ALL SELECT record, 1, session, turn, content FROM h WHERE marked UNION ALL
    SELECT record, 2, session, turn, content FROM h WHERE near AND (hit OR NOT any_hit) UNION ALL SELECT record, 3, session, turn, content FROM h WHERE hit),
  f AS (SELECT record, tier, content, min(session * 1000000 + turn) AS first_at FROM x WHERE tier = (SELECT min(tier) FROM x y WHERE y.record = x.record) GROUP BY ALL)
  SELECT record, CASE tier WHEN 0 THEN 'explicit' WHEN 1 THEN 'marked' WHEN 2 THEN 'session' ELSE 'answer' END AS tier, CAST(row_number() OVER (PARTITION BY record ORDER BY first_at) - 1 AS INTEGER) AS place, content FROM f""")
def b3_evidence(spark, sf_dir):
    """The answer is the second word of a record's first message; every seventh record states its evidence, every second one a session."""
    said = F.filter(F.transform(F.flatten("haystack_sessions"), lambda m: F.nullif(F.trim(m["content"]), F.lit(""))), lambda c: c.isNotNull())
    first = F.try_element_at(said, F.lit(1))
    rows = _records(spark, sf_dir).withColumn("answer", F.split_part(first, F.lit(" "), F.lit(2)))
    rows = rows.withColumn("evidence", F.when(F.col("record") % 7 == 0, F.concat(F.lit("given "), F.col("record").cast("string"))))
    rows = rows.withColumn("answer_session_ids", F.when(F.col("record") % 2 == 0, F.array(F.lit("s1"))))
    return N.evidence(rows, "record", "haystack_sessions", "haystack_session_ids", "answer_session_ids", ["answer", "answers"], ["evidence", "evidence_text"])


@_query("""WITH l AS (SELECT conv_id, sha256(turn || ':' || coalesce(role, '') || ':') AS h FROM conversations WHERE turn % 8 < 6),
  s AS (SELECT conv_id, substr(sha256(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) || ':' || count(*)), 1, 20) AS signature, count(*) AS n FROM l GROUP BY conv_id),
  o AS (SELECT signature, min(conv_id) AS owner FROM s GROUP BY signature)
  SELECT s.conv_id, CASE WHEN owner % 5 = 0 AND n > 1 THEN 'count' WHEN owner % 5 = 0 THEN 'missing' ELSE 'ok' END AS verdict, CASE WHEN owner % 5 = 0 THEN 0 ELSE n END AS n_messages FROM s JOIN o USING (signature)""")
def b12_rehydrated(spark, sf_dir):
    """Roles as histories, stored once. The stores of every fifth owner have lost their first message."""
    turns = _TURNS(spark, sf_dir).where("turn % 8 < 6").select("conv_id", "turn", "role", F.lit("").alias("content"))
    refs = N.history_refs(turns, "conv_id", "turn", "role", "content")
    owned = N.stored_histories(turns.withColumn("owner", F.col("conv_id")), refs, "conv_id")
    first = owned.groupBy("signature").agg(F.min("turn").alias("first"))
    stored = owned.join(first, "signature").where("owner % 5 <> 0 OR turn <> first")
    return N.rehydrated(refs, stored, "conv_id", ["turn", "role"]).groupBy("conv_id", "verdict").agg(F.count("turn").alias("n_messages"))
