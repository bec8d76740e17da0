"""Contexts of retrieved rows: hits packed whole while they fit a token budget, and scheduled origins packed in order with the last one cut.

Null texts are empty, repeated ids of a text count as their longest row, and an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .folds import skip_pack
from .retrieval import scheduled


def packed_hits(hits: DataFrame, texts: DataFrame, query: str, item: str, rank: str, id_col: str, text: str, budget: int) -> DataFrame:
    """query, item, used: a query's hits in order of rank while they fit; one that does not is left out and the next is tried. Only texts of hits are cut into tokens; hits without text row take no part."""
    found = hits.select(F.col(query), F.col(item), F.col(rank)).join(texts.select(F.col(id_col).alias(item), F.col(text).alias("_text")), item)
    sized = found.groupBy(query, item, rank).agg(F.max(F.size(tokens(F.col("_text")))).alias("_n"))
    return skip_pack(sized, query, [F.col(rank)], item, F.col("_n"), budget)


def packed_schedule(items: DataFrame, positions: DataFrame, key: str, at: str, text: str, opens: int, closes: int, budget: int) -> DataFrame:
    """key, at, origin, n_tokens, cut, body: for each position the texts of the items that are due there, earliest first, under the budget.

    The text that passes the budget is cut to its first tokens, joined by blanks; what comes after it, and texts without tokens, give no row.
    """
    due = scheduled(items, positions, key, at, opens, closes)
    size = F.size(tokens(F.col(text)))
    once = items.groupBy(key, F.col(at).alias("origin")).agg(F.max(F.struct(size.alias("n"), F.coalesce(F.col(text), F.lit("")).alias("text"))).alias("_t"))
    before = F.coalesce(F.sum("_t.n").over(Window.partitionBy(key, at).orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = due.join(once, [key, "origin"]).withColumn("_room", F.lit(budget) - before).where("_room > 0 AND _t.n > 0")
    kept = F.least(F.col("_t.n"), F.col("_room")).cast("long")
    cut = F.col("_t.n") > F.col("_room")
    body = F.when(cut, F.array_join(F.slice(tokens(F.col("_t.text")), F.lit(1), kept.cast("int")), " ")).otherwise(F.col("_t.text"))
    return rows.select(key, at, "origin", kept.alias("n_tokens"), cut.alias("cut"), body.alias("body"))
