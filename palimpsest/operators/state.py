"""Versioned state over ordered events, and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, version (from 1), order, value, prior, superseded_by, status: every write of a key supersedes the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.row_number().over(w)
    after = F.lead(order).over(w)
    return events.select(*keys, v.alias("version"), order, value, F.lag(order).over(w).alias("prior"), after.alias("superseded_by"), F.when(after.isNull(), "active").otherwise("superseded").alias("status"))


def latest(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n_versions, value: the live view of each key."""
    return events.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.max_by(value, order).alias(value))


def as_of_usage(events: DataFrame, group: str, target: str, order: str) -> DataFrame:
    """group, order, target, refs, last_use: for each event how often, and when last, its target was used before in its group."""
    w = Window.partitionBy(group, target).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return events.select(group, order, target, F.count("*").over(before).alias("refs"), F.max(order).over(before).alias("last_use"))


def changed(old: DataFrame, new: DataFrame, id_col: str, digest: str) -> DataFrame:
    """id, action: reuse where id and digest match, process where not, drop where the id is gone."""
    o, n = old.select(id_col, F.col(digest).alias("o")), new.select(id_col, F.col(digest).alias("n"))
    both = n.join(o, id_col, "full_outer")
    return both.select(id_col, F.when(F.col("n").isNull(), "drop").when(F.col("n").eqNullSafe(F.col("o")), "reuse").otherwise("process").alias("action"))


def reconciled(expected: DataFrame, found: DataFrame, id_col: str, value: str) -> DataFrame:
    """id, verdict: match, mismatch, missing or extra."""
    e, f = expected.select(id_col, F.col(value).alias("e"), F.lit(1).alias("in_e")), found.select(id_col, F.col(value).alias("f"), F.lit(1).alias("in_f"))
    both = e.join(f, id_col, "full_outer")
    return both.select(id_col, F.when(F.col("in_f").isNull(), "missing").when(F.col("in_e").isNull(), "extra").when(F.col("e").eqNullSafe(F.col("f")), "match").otherwise("mismatch").alias("verdict"))


def batch_ledger(rows: DataFrame, id_col: str, size: int, text: str) -> DataFrame:
    """batch, n, digest: `size` places of ids to a batch, with a digest of its ids and texts in order, by which a later run knows what is done."""
    line = F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    ordered = F.array_sort(F.collect_list(F.struct(id_col, line.alias("x"))))
    out = rows.groupBy(F.floor(F.col(id_col) / size).alias("batch")).agg(F.count("*").alias("n"), ordered.alias("_rows"))
    return out.select("batch", "n", F.sha2(F.array_join(F.transform("_rows", lambda r: r["x"]), "\n"), 256).alias("digest"))


def grounded_versions(updates: DataFrame, scope: str, key: str, order: str, value: str, seen: str) -> DataFrame:
    """scope, order, key, value, accepted, version: updates whose value occurs in what was seen, numbered within (scope, key); others have no version."""
    ok = F.coalesce((F.col(value) != "") & F.contains(F.lower(seen), F.lower(value)), F.lit(False))
    marked = updates.select(scope, order, key, value, ok.alias("accepted"))
    count = F.sum(F.col("accepted").cast("int")).over(Window.partitionBy(scope, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("version", F.when(F.col("accepted"), count).cast("int"))


def validated_batches(rows: DataFrame, batch: list[str], key: str, ok: str, most: int) -> DataFrame:
    """batch columns, n, verdict: too many (over `most` rows), repeated key, invalid (a row is not ok) or ok; the first that holds."""
    out = rows.groupBy(*batch).agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("bad"))
    verdict = F.when(F.col("n") > most, "too many").when(F.col("d") < F.col("n"), "repeated key").when(F.col("bad") > 0, "invalid").otherwise("ok")
    return out.select(*batch, "n", verdict.alias("verdict"))


def rolling_summaries(rows: DataFrame, group: str, order: str, volume: str, summary: str, last: int) -> DataFrame:
    """group, order, rolling (the summary one step back), volumes (the last summary of each earlier volume), recent (the `last` summaries before), joined by |."""
    w = Window.partitionBy(group).orderBy(order)
    end = F.coalesce(F.lead(volume).over(w) != F.col(volume), F.lit(False))
    marked = rows.withColumn("_end", end)
    closed = F.collect_list(F.when(F.col("_end"), F.col(summary))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    recent = F.collect_list(summary).over(w.rowsBetween(-last, -1))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return marked.select(group, order, F.lag(summary).over(w).alias("rolling"), joined(closed).alias("volumes"), joined(recent).alias("recent"))
