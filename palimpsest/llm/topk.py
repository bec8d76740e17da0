"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection in each tile, tree merging.

Both sides are cut into blocks of bounded size. A tile is one query block against one shard; its task keeps the k
best of each query only. The lists of a query are then merged in rounds of `FAN_IN` lists until one is left. Neither side
is broadcast or collected.

Vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths are
not compared; empty vectors score 0. Rows with a null id take no part. Repeated ids are rows of their own, except that a query never finds rows
of its own id, and a repeated query id gives one list, over its smallest vector's copies as they come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

TILE_QUERIES, TILE_ROWS, FAN_IN = 2048, 16384, 8


def quantized(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vec array<double>): floor(scale * x) of each component; unusable vectors are left out."""
    x = F.col("v").cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    df = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].alias("v"))
    return df.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("vec"))


def _tile(k: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            tile, size_q, size_r = int(rows["tile_r"].iloc[0]), queries["vec"].map(len), rows["vec"].map(len)
            for d in sorted(set(size_q) & set(size_r)):
                q, r = queries[size_q == d], rows[size_r == d].sort_values("vec_id", kind="stable")
                a = np.stack(q["vec"].to_numpy()).astype(float).reshape(len(q), d)
                b = np.stack(r["vec"].to_numpy()).astype(float).reshape(len(r), d)
                exact = d * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) < 2**53
                if not exact:
                    a, b = a.astype(np.int64), b.astype(np.int64)
                qid, rid = q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
                for i in range(0, len(a), 256):
                    part = (a[i : i + 256] @ b.T).astype(np.int64)
                    low = np.iinfo(np.int64).min
                    own = qid[i : i + 256, None] == rid[None, :]
                    part[own] = low
                    m = min(k, part.shape[1])
                    # The m-th best score of each query; all above it stay, and of its ties the smallest ids.
                    edge = np.partition(part, part.shape[1] - m, axis=1)[:, part.shape[1] - m]
                    for j in range(len(part)):
                        at = np.flatnonzero((part[j] >= edge[j]) & ~own[j])
                        at = at[np.argsort(-part[j, at], kind="stable")][:m]
                        out.append(pd.DataFrame({"query_id": qid[i + j], "vec_id": rid[at], "score": part[j, at], "lists": tile}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "lists": []}).astype("int64")

    return best


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product, ties to the smaller vec_id.

    queries and rows are frames as `quantized` makes them; a query's own id is no candidate. Fewer than k rows: all.
    """
    queries, rows = materialize(queries.dropDuplicates(["vec_id"])), materialize(rows)
    n_q, n_r = -(-max(1, queries.count()) // TILE_QUERIES), -(-max(1, rows.count()) // TILE_ROWS)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    q = queries.withColumn("tile_q", block(n_q, 1)).withColumn("tile_r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = rows.withColumn("tile_r", block(n_r, 2)).withColumn("tile_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    lists = q.groupBy("tile_q", "tile_r").cogroup(r.groupBy("tile_q", "tile_r")).applyInPandas(_tile(k), "query_id long, vec_id long, score long, lists long")
    best = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))
    while n_r > FAN_IN:
        n_r = -(-n_r // FAN_IN)
        lists = lists.withColumn("lists", F.floor(F.col("lists") / FAN_IN)).withColumn("rank", best("lists")).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", best()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(load(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows, 20)


SQL = {
    "op1_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.vec, r.vec) AS BIGINT) AS score
              FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 20"""
}
