"""The attribution query: each conversation is a hook whose fact is planted in its first turn and remembered, or not, by later ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from .registry import _TURNS, _query

_HOOKS = """t AS (SELECT conv_id AS h, CAST(turn AS INTEGER) AS c, length(coalesce(text, '')) AS n FROM conversations),
  hk AS (SELECT h, max(c) AS last, ['none', 'attempted', 'auxiliary', 'essential'][h % 4 + 1] AS route, h % 5 <> 0 AS gold FROM t GROUP BY h),
  p AS (SELECT unnest(range(3)) AS p),
  ch AS (SELECT h, p, ['D', 'T', 'T', 'T', 'N'][(h + p) % 5 + 1] AS provenance, (h + p) % 7 = 0 AS disclosed, (3 * h + p) % 13 = 0 AS laundered, (h + 2 * p) % 11 = 0 AS conflict, (h + p) % 9 <> 8 AS used FROM hk, p),
  hi AS (SELECT h, p, c, n > 0 AS grounded, n % 11 = 0 AS in_prompt, CASE WHEN n % 2 = 0 THEN 'D' ELSE 'T' END AS cap, list_filter([c - 1, c - 2, 0], lambda x: x >= 0) AS drawn, CASE WHEN n % 3 = 0 THEN c - 1 ELSE 0 END AS s, (n + p) % 6 <> 0 AS put
    FROM t, p WHERE c >= 2 AND (n + p * c) % 3 <> 0)"""
_CHAINS = """ol AS (SELECT h, p, min(grounded) AS out_ok, list(c) AS outs FROM hi WHERE put GROUP BY h, p),
  o AS (SELECT *, row_number() OVER (PARTITION BY h, p ORDER BY c) AS i, count(*) OVER (PARTITION BY h, p) AS m FROM hi),
  w AS (SELECT h, p, i, m, c, cap, drawn, [0] AS carriers, false AS ok FROM o WHERE false UNION ALL SELECT h, p, 0, max(m), 0, '', [0], [0], true FROM o GROUP BY h, p UNION ALL
    SELECT o.h, o.p, o.i, o.m, o.c, o.cap, o.drawn, list_append(w.carriers, o.c), w.ok AND o.grounded AND NOT o.in_prompt AND list_contains(o.drawn, o.s) AND o.s < o.c AND list_contains(w.carriers, o.s) FROM w JOIN o ON o.h = w.h AND o.p = w.p AND o.i = w.i + 1),
  v AS (SELECT ch.h, ch.p, ch.disclosed, coalesce(ch.provenance IN ('D', 'T') AND ch.used AND NOT ch.disclosed AND NOT ch.laundered AND NOT ch.conflict AND ol.out_ok AND w.ok AND list_contains([2, 3, 4, 5, 7], w.c) AND list_contains(ol.outs, w.c)
    AND (ch.provenance <> 'D' OR (w.cap = 'D' AND list_contains(w.drawn, 0))), false) AS valid FROM ch LEFT JOIN ol ON ol.h = ch.h AND ol.p = ch.p LEFT JOIN w ON w.h = ch.h AND w.p = ch.p AND w.i = w.m)"""


def _hooks(turns):
    route = F.array(*[F.lit(r) for r in ("none", *A.VALID_ROUTES)])
    hooks = turns.groupBy("hook").agg(F.max("place").alias("last"))
    names = lambda *n: F.array(*map(F.lit, n))
    return hooks.select(
        "hook", "last", F.lit(0).alias("plant"), F.lit(2).alias("trigger"), F.lit(2).alias("window_start"), F.col("last").alias("window_end"), F.array(*map(F.lit, (2, 3, 4, 5, 7))).alias("scoring"),
        route[(F.col("hook") % 4).cast("int")].alias("route"), (F.col("hook") % 5 != 0).alias("gold"), names("p0", "p1").alias("seeds"), names("p1", "p2").alias("attrs"),
    )


def _parts(spark, sf_dir):
    turns = _TURNS(spark, sf_dir).select(F.col("conv_id").alias("hook"), F.col("turn").cast("int").alias("place"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    hooks = _hooks(turns)
    each = lambda rows: rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("predicate", F.concat(F.lit("p"), F.col("p").cast("string")))
    h, p, n, c = F.col("hook"), F.col("p"), F.col("n"), F.col("place")
    kinds = F.array(*map(F.lit, "DTTTN"))
    chains = each(hooks.select("hook")).select("hook", "predicate", kinds[((h + p) % 5).cast("int")].alias("provenance"), ((h + p) % 7 == 0).alias("disclosed"), ((3 * h + p) % 13 == 0).alias("laundered"), ((h + 2 * p) % 11 == 0).alias("conflict"), ((h + p) % 9 != 8).alias("used"))
    cited = each(turns.where("place >= 2")).where((n + p * c) % 3 != 0).withColumn("unit", F.concat(F.lit("u"), c.cast("string"))).withColumn("grounded", n > 0)
    drawn = F.filter(F.array(c - 1, c - 2, F.lit(0)), lambda x: x >= 0)
    history = cited.select("hook", "predicate", "place", "unit", "grounded", (n % 11 == 0).alias("in_prompt"), F.when(n % 2 == 0, "D").otherwise("T").alias("cap"), drawn.alias("unit_sources"))
    sources = cited.select("hook", "predicate", "unit", F.when(n % 3 == 0, c - 1).otherwise(0).alias("place"), F.lit(True).alias("grounded"))
    outputs = cited.where((n + p) % 6 != 0).select("hook", "predicate", "place", "grounded")
    return turns, hooks, chains, outputs, history, sources


@_query(f"""WITH RECURSIVE {_HOOKS}, {_CHAINS},
  e AS (SELECT v.h, bool_or(valid AND v.p > 0) AS a_min, count(*) FILTER (v.p < 2 AND NOT disclosed) AS eligible, count(*) FILTER (v.p < 2 AND NOT disclosed AND valid) AS held FROM v GROUP BY v.h),
  a AS (SELECT h, min(c) FILTER (c = 1) AS resource, min(c) FILTER (c = 2) AS problem, min(c) FILTER (c = 3) AS result, count(*) FILTER (c > 3) AS after, bool_and(n > 0) FILTER (c > 0) AS fine, max(n) FILTER (c = 0) AS prompt FROM t GROUP BY h),
  l AS (SELECT h, coalesce(h % 6 <> 0 AND fine AND resource = 1 AND problem = 2 AND result = 3 AND after > 0 AND CASE h % 4 WHEN 0 THEN prompt > 0 WHEN 1 THEN h % 3 = 0 WHEN 2 THEN true ELSE CAST(prompt > 0 AS INTEGER) + CAST(h % 3 = 0 AS INTEGER) + 1 >= 2 END, false) AS local FROM a),
  f AS (SELECT hk.h, route, gold, a_min, a_min AND eligible > 0 AND held = eligible AS a_full, eligible, local FROM hk JOIN e USING (h) JOIN l USING (h))
  SELECT h AS hook, a_min, a_full, CASE WHEN a_full THEN 'full' WHEN a_min THEN 'min' WHEN eligible = 0 THEN 'unidentifiable' ELSE 'none' END AS status,
    CASE WHEN a_full AND route IN ('auxiliary', 'essential') AND gold THEN 'G' WHEN a_min AND route <> 'none' THEN 'P' WHEN NOT a_min AND local THEN 'L' ELSE 'F' END AS category FROM f""")
def k11_attribution(spark, sf_dir):
    turns, hooks, chains, outputs, history, sources = _parts(spark, sf_dir)
    h, c = F.col("hook"), F.col("place")
    roles = F.when(c == 1, F.array(F.lit("resource"), F.lit("verification"))).when(c == 2, F.array(F.lit("problem"), F.lit("operation"))).when(c == 3, F.array(F.lit("mechanism"), F.lit("result"))).otherwise(F.array(F.lit("continuity")))
    anchors = turns.where("place > 0").select("hook", "place", (F.col("n") > 0).alias("grounded"), F.explode(roles).alias("role"))
    support = F.array(*map(F.lit, ("prompt_scaffolded", "historical_alternative", "window_verified", "mixed")))
    resolutions = hooks.select("hook", (h % 6 != 0).alias("basic"), support[(h % 4).cast("int")].alias("subtype"))
    prompts = turns.where("place = 0").select("hook", (F.col("n") > 0).alias("grounded"))
    histories = hooks.select("hook", F.lit(True).alias("grounded"), F.array(F.when(h % 3 == 0, 1).otherwise(2)).alias("unit_sources"))
    local = A.local_resolutions(hooks, resolutions, anchors, prompts, histories)
    return A.categories(hooks, chains, A.valid_chains(hooks, chains, outputs, history, sources), local)


@_query(f"WITH RECURSIVE {_HOOKS}, {_CHAINS} SELECT h AS hook, 'p' || p AS predicate, valid FROM v")
def k11_valid_chains(spark, sf_dir):
    return A.valid_chains(*_parts(spark, sf_dir)[1:])
