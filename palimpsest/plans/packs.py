"""Queries over ordered groups: packing, batching, diversified lists, collapsing, fragments and sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, tokens
from ..operators import folds
from ..operators import retrieval as R
from ..sources.records import table
from .registry import _CONV_TOKENS, _DOCS, _FOUND, _SQUEEZE, _TURNS, _query


def _greedy_sql(rows: str, group: str, order: str, target: int, most: int, tail: int, most_rows: int) -> str:
    close = f"f.used >= {target} OR f.used + t.size > {most} OR f.n >= {most_rows}"
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS p FROM ({rows})),
  f AS (SELECT {group}, {order}, p, size, 0 AS unit, size AS used, 1 AS n FROM t WHERE p = 1 UNION ALL
    SELECT t.{group}, t.{order}, t.p, t.size, CASE WHEN {close} THEN f.unit + 1 ELSE f.unit END, CASE WHEN {close} THEN t.size ELSE f.used + t.size END,
      CASE WHEN {close} THEN 1 ELSE f.n + 1 END FROM f JOIN t ON t.{group} = f.{group} AND t.p = f.p + 1),
  l AS (SELECT {group}, max(unit) AS last FROM f GROUP BY {group}), u AS (SELECT {group}, last, sum(size) AS left_over FROM f JOIN l USING ({group}) WHERE unit = last GROUP BY ALL)
  SELECT {group}, {order}, CAST(unit - CASE WHEN unit = last AND last > 0 AND left_over < {tail} THEN 1 ELSE 0 END AS INTEGER) AS unit, size FROM f JOIN u USING ({group})"""


_TURN_SIZES = f"SELECT conv_id, turn, CAST(len({_CONV_TOKENS}) AS BIGINT) AS size FROM conversations"
_ORDER_SIZES = "SELECT o_custkey, o_orderkey, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS size FROM orders"


@_query(_greedy_sql(_TURN_SIZES, "conv_id", "turn", 60, 90, 20, 1 << 30))
def d5_packed_units(spark, sf_dir):
    return folds.greedy_groups(_TURNS(spark, sf_dir), "conv_id", "turn", F.size(tokens(F.col("text"))), 60, 90, 20)


@_query(_greedy_sql(_ORDER_SIZES, "o_custkey", "o_orderkey", 1 << 40, 500, 0, 1 << 30))
def d9_length_bounded_packs(spark, sf_dir):
    return folds.greedy_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.ceil(F.col("o_totalprice") / 1000), 1 << 40, 500)


@_query(_greedy_sql(_ORDER_SIZES, "o_custkey", "o_orderkey", 1 << 40, 768, 0, 4))
def h6_cost_bounded_batches(spark, sf_dir):
    return folds.greedy_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.ceil(F.col("o_totalprice") / 1000), 1 << 40, 768, 0, 4)


def _skip_sql(size: str, budget: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CAST({size} AS BIGINT) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations),
  f AS (SELECT conv_id, turn, p, v <= {budget} AS fits, CASE WHEN v <= {budget} THEN v ELSE 0 END AS used FROM t WHERE p = 1 UNION ALL
    SELECT t.conv_id, t.turn, t.p, f.used + t.v <= {budget}, CASE WHEN f.used + t.v <= {budget} THEN f.used + t.v ELSE f.used END FROM f JOIN t ON t.conv_id = f.conv_id AND t.p = f.p + 1)
  SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM f WHERE fits"""


@_query(_skip_sql(f"len({_CONV_TOKENS})", 100))
def i2_skip_if_not_fit(spark, sf_dir):
    return folds.skip_pack(_TURNS(spark, sf_dir), "conv_id", [-F.col("turn")], "turn", F.size(tokens(F.col("text"))), 100)


@_query(f"""WITH k AS ({_skip_sql("length(coalesce(text, ''))", 600)})
  SELECT conv_id, string_agg(turn || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM k JOIN conversations USING (conv_id, turn) GROUP BY conv_id""")
def f10_flat_history(spark, sf_dir):
    turns = _TURNS(spark, sf_dir)
    kept = folds.skip_pack(turns, "conv_id", [-F.col("turn")], "turn", F.length(F.coalesce("text", F.lit(""))), 600)
    line = F.concat(F.col("turn").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))
    rows = turns.join(kept.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").groupBy("conv_id")
    return rows.agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n").alias("history"), F.count("*").alias("n_turns"))


@_query(f"""WITH RECURSIVE {_FOUND},
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  t AS (SELECT query, doc, source, rank, {_SQUEEZE} AS t FROM r JOIN documents ON doc = doc_id WHERE rank <= 40),
  f AS (SELECT query, doc, source, rank, true AS take, [t] AS ts, [source] AS gs FROM t WHERE rank = 1 UNION ALL
    SELECT t.query, t.doc, t.source, t.rank, NOT list_contains(ts, t.t) AND len(list_filter(gs, lambda x: x = t.source)) < 3 AND len(ts) < 10,
      CASE WHEN NOT list_contains(ts, t.t) AND len(list_filter(gs, lambda x: x = t.source)) < 3 AND len(ts) < 10 THEN list_append(ts, t.t) ELSE ts END,
      CASE WHEN NOT list_contains(ts, t.t) AND len(list_filter(gs, lambda x: x = t.source)) < 3 AND len(ts) < 10 THEN list_append(gs, t.source) ELSE gs END
    FROM f JOIN t ON t.query = f.query AND t.rank = f.rank + 1)
  SELECT query, doc, source, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS place FROM f WHERE take""")
def g17_diversified(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    hits = R.term_hits(table(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", "text", 40)
    hits = hits.join(docs.select(F.col("doc_id").alias("doc"), "source", "text"), "doc")
    return folds.diversified(hits, "query", "rank", "doc", "source", squeezed(F.col("text")), 3, 10)


@_query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_SQUEEZE} AS t FROM conversations),
  b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(t) DESC, turn) AS p, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS b FROM t),
  d AS (SELECT y.conv_id, y.p, list(x.p) AS ds FROM b x JOIN b y ON x.conv_id = y.conv_id AND x.p < y.p AND (x.t = y.t OR (length(y.t) >= 8 AND contains(x.t, y.t))
      OR len(list_intersect(x.b, y.b)) >= 0.72 * greatest(len(list_distinct(list_concat(x.b, y.b))), 1)) GROUP BY ALL),
  r AS (SELECT b.conv_id, b.turn, b.p, coalesce(ds, []) AS ds FROM b LEFT JOIN d USING (conv_id, p)),
  f AS (SELECT conv_id, turn, p, true AS kept, [p] AS ks FROM r WHERE p = 1 UNION ALL
    SELECT r.conv_id, r.turn, r.p, len(list_intersect(r.ds, ks)) = 0, CASE WHEN len(list_intersect(r.ds, ks)) = 0 THEN list_append(ks, r.p) ELSE ks END FROM f JOIN r ON r.conv_id = f.conv_id AND r.p = f.p + 1)
  SELECT conv_id, turn, kept FROM f""")
def j1_collapsed(spark, sf_dir):
    return folds.collapsed(_TURNS(spark, sf_dir), "conv_id", "turn", squeezed(F.col("text")))


@_query("""WITH h AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations),
  c AS (SELECT *, CASE WHEN role = 'user' THEN greatest(length(text), 1) ELSE 120 END AS size FROM h),
  s AS (SELECT *, unnest(range(0, CAST(ceil(greatest(length(text), 1) / size) AS BIGINT))) AS fragment FROM c)
  SELECT conv_id, turn, header, CAST(fragment AS INTEGER) AS fragment, CAST(ceil(greatest(length(text), 1) / size) AS INTEGER) AS n_fragments, substr(text, fragment * size + 1, size) AS body FROM s""")
def d3_line_fragments(spark, sf_dir):
    carried = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _TURNS(spark, sf_dir).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), carried.alias("header"))
    n = F.greatest(F.length("text"), F.lit(1))
    rows = rows.withColumn("size", F.when(F.col("role") == "user", n).otherwise(120))  # header rows are never split
    count = F.ceil(n / F.col("size")).cast("int")
    rows = rows.withColumn("n_fragments", count).withColumn("fragment", F.explode(F.sequence(F.lit(0), F.col("n_fragments") - 1)))
    return rows.select("conv_id", "turn", "header", "fragment", "n_fragments", F.substring("text", F.col("fragment") * F.col("size") + 1, F.col("size")).alias("body"))


_SENTENCE = r"[^.!?\n]+[.!?\n]*|[.!?\n]+"


@_query(f"""WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SENTENCE}') AS s FROM documents),
  e AS (SELECT doc_id, unnest(s) AS x, unnest(range(0, len(s))) AS place FROM s),
  o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
  SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(start AS BIGINT) AS start, trim(x, chr(32) || chr(10)) AS sentence,
    CASE WHEN contains(x, '?') THEN 'question' WHEN regexp_matches(x, '[0-9]') THEN 'number' ELSE 'statement' END AS kind, place < 12 AS among_first FROM o WHERE trim(x, chr(32) || chr(10)) <> ''""")
def d4_sentences(spark, sf_dir):
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_SENTENCE})"), F.lit(1))
    rows = _DOCS(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("place", "x"))
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("x")).over(before), F.lit(0)))
    kind = F.when(F.contains("x", F.lit("?")), "question").when(F.col("x").rlike("[0-9]"), "number").otherwise("statement")
    body = F.expr("trim(both ' \n' from x)")
    return rows.select("doc_id", "place", "start", body.alias("sentence"), kind.alias("kind"), (F.col("place") < 12).alias("among_first")).where("sentence <> ''")


@_query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  m AS (SELECT *, coalesce(least(nullif(strpos(text, chr(10)), 0), nullif(strpos(text, '?'), 0), nullif(strpos(text, '!'), 0)), length(text) + 1) AS found FROM t)
  SELECT doc_id, CAST(found - 1 AS INTEGER) AS n_before, substr(text, 1, found - 1) AS instruction, substr(text, found) AS history FROM m""")
def d7_least_marker(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    places = [F.nullif(F.locate(m, text), F.lit(0)) for m in ("\n", "?", "!")]
    rows = _DOCS(spark, sf_dir).select("doc_id", text.alias("t"), F.coalesce(F.least(*places), F.length(text) + 1).alias("at"))
    return rows.select("doc_id", (F.col("at") - 1).alias("n_before"), F.substring("t", F.lit(1), F.col("at") - 1).alias("instruction"), F.substring("t", F.col("at"), F.length("t")).alias("history"))


@_query(f"""WITH t AS (SELECT conv_id, turn, role, {_CONV_TOKENS} AS t FROM conversations), r AS (SELECT *, sum(len(t) + 1) OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS run FROM t)
  SELECT conv_id, role, turn, CAST(least(len(t), 80 - (run - len(t))) AS INTEGER) AS n_tokens FROM r WHERE 80 - (run - len(t)) > 0 AND len(t) > 0""")
def i6_subject_projection(spark, sf_dir):
    t = _TURNS(spark, sf_dir).select("conv_id", "role", "turn", F.size(tokens(F.col("text"))).alias("n"))
    run = F.sum(F.col("n") + 1).over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - 1
    t = t.withColumn("room", F.lit(80) - (run - F.col("n"))).where("room > 0 and n > 0")
    return t.select("conv_id", "role", "turn", F.least("n", "room").cast("int").alias("n_tokens"))


@_query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM h),
  e AS (SELECT query, rank, '[' || rank || '] ' || source || ' #' || doc AS line FROM r JOIN documents ON doc = doc_id WHERE rank <= 3)
  SELECT query, string_agg(line, chr(10) ORDER BY rank) AS context, count(*) AS n FROM e GROUP BY query""")
def i5_context(spark, sf_dir):
    docs = _DOCS(spark, sf_dir)
    hits = R.term_hits(table(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", "text", 3).join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit(" #"), F.col("doc").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("x"))))
    return hits.groupBy("query").agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n").alias("context"), F.count("*").alias("n"))
