"""Queries of memory strategies and of a build that is stopped and resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.tables import shared_folder
from ..sources import builds as B
from ..streaming import strategies as M
from .registry import _CONV_TOKENS, _DOCS, _TURNS, _plain, _query

_NEWEST = f"""t AS (SELECT conv_id AS subject, turn AS place, len({_CONV_TOKENS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
  e AS (SELECT a.subject, a.place AS as_of, b.place, b.n, sum(b.n) OVER (PARTITION BY a.subject, a.place ORDER BY b.p DESC) AS used, max(CASE WHEN b.n > 0 THEN b.p END) OVER (PARTITION BY a.subject, a.place) AS newest, b.p FROM t a JOIN t b ON b.subject = a.subject AND b.p <= a.p - 2)"""


@_query(f"WITH {_NEWEST} SELECT subject, as_of, place, CAST(least(used, 150) AS BIGINT) AS used FROM e WHERE n > 0 AND (used <= 150 OR p = newest)")
def o3_recency_contexts(spark, sf_dir):
    log = M.log_rows(_TURNS(spark, sf_dir), "conv_id", "turn", "text")
    return M.recency(150).contexts(log, log)


@_plain
def o3_vector_contexts(spark, sf_dir):
    """Hashed bigrams as vectors: what comes before the same turn of the same conversation."""
    log = M.log_rows(_TURNS(spark, sf_dir), "conv_id", "turn", "text")
    return M.vector(S.hashed_bigrams, 8, 300).contexts(log, log)


@_query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL")
def n8_resumed_build(spark, sf_dir):
    """A table of digests in some eight batches, stopped after three and resumed."""
    docs, path = _DOCS(spark, sf_dir), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = max(1, -(-docs.count() // 8))
    build = lambda part: part.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    B.built(docs, "doc_id", path, build, rows, "sha256 of texts", most=3)
    B.built(docs, "doc_id", path, build, rows, "sha256 of texts")
    return B.finalised(spark, path).select("doc_id", "digest")
