"""Queries of grounding by ordered fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding as G
from ..sources.records import table
from .registry import _DOCS, _query

_SILENT = r"[\pP\pZ\s\x0B\x1C-\x1F\x{85}\x{FEFF}\x{FFFD}]+"


def _normal_sql(text: str) -> str:
    return f"regexp_replace(lower(translate(coalesce({text}, ''), '{G.WIDE}', '{G.NARROW.replace(chr(39), chr(39) * 2)}')), '{_SILENT}', '', 'g')"


_CLAIMS = """SELECT item_id AS claim, text FROM benchmark UNION ALL SELECT item_id + 1000000, array_to_string(list_filter(string_split(text, '. '), lambda x, i: i % 2 = 1), '; ') FROM benchmark"""


@_query(f"""WITH c AS (SELECT claim, {_normal_sql('text')} AS whole, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n。！？；!?;]+'), lambda f: {_normal_sql('f')}), lambda f: length(f) >= 8) AS pieces FROM ({_CLAIMS})),
  s AS (SELECT doc_id AS source, {_normal_sql('text')} AS t FROM documents),
  m AS (SELECT claim, source, length(whole) >= 8 AND contains(t, whole) AS is_whole, strpos(t, whole) - 1 AS whole_at, strpos(t, pieces[1]) - 1 AS first_at, t, pieces FROM c JOIN s ON (length(whole) >= 8 AND contains(t, whole)) OR (len(pieces) > 0 AND contains(t, pieces[1]))),
  r AS (SELECT *, len(pieces) > 0 AND list_reduce(list_prepend(t, pieces), lambda rest, f: CASE WHEN rest IS NULL OR strpos(rest, f) = 0 THEN NULL ELSE substr(rest, strpos(rest, f) + length(f)) END) IS NOT NULL AS in_order FROM m)
  SELECT claim, source, CASE WHEN is_whole THEN 'whole' ELSE 'fragments' END AS mode, CAST(CASE WHEN is_whole THEN whole_at ELSE first_at END AS BIGINT) AS place FROM r WHERE is_whole OR in_order""")
def j2_fragments(spark, sf_dir):
    """Benchmark items as they are, and with every second sentence left out, against all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), "text")
    thinned = F.array_join(F.filter(F.split("text", r"\. "), lambda x, i: i % 2 == 0), "; ")
    claims = items.union(items.select(F.col("claim") + 1000000, thinned))
    return G.grounded(claims, _DOCS(spark, sf_dir), "claim", "doc_id", "text")
