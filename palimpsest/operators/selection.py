"""Deterministic sampling and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(rows: DataFrame, stratum: str, id_col: str, n: int) -> DataFrame:
    """Rows by depth over strata: each stratum in order of its ids' digests, strata in their own order, the first n."""
    depth = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.col(id_col).cast("string"), 256), id_col))
    # no stratum gives more than n rows: this lets the ranks be cut before the shuffle
    return rows.select(id_col, stratum, depth.alias("depth")).where(F.col("depth") <= n).orderBy("depth", stratum).limit(n)


def proportional(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """A prefix of each stratum; the sizes share n by largest remainder, ties to the smaller stratum."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = counts.agg(F.sum("size").alias("total"))
    quota = F.lit(n) * F.col("size") / F.col("total")
    shares = counts.crossJoin(total).select(stratum, F.floor(quota).alias("base"), (quota - F.floor(quota)).alias("over"))  # one row on the right
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    shares = shares.select(stratum, (F.col("base") + F.when(F.row_number().over(Window.orderBy(F.desc(F.round("over", 9)), stratum)) <= left, 1).otherwise(0)).alias("quota"))  # a row for each stratum
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("rn") <= n)  # no quota is above n
    return ranked.join(shares, stratum).where(F.col("rn") <= F.col("quota")).select(stratum, order, "rn")


def refill(old: DataFrame, allowed: DataFrame, pool: DataFrame, stratum: str, id_col: str, seed: int) -> DataFrame:
    """id, stratum, kept: allowed members of the old sample, and seeded replacements up to each stratum's old size."""
    kept = old.join(allowed.select(id_col), id_col, "left_semi")
    need = old.groupBy(stratum).agg(F.count("*").alias("target")).join(kept.groupBy(stratum).agg(F.count("*").alias("have")), stratum, "left")
    need = need.select(stratum, (F.col("target") - F.coalesce("have", F.lit(0))).alias("need"))
    fresh = pool.join(old.select(id_col), id_col, "left_anti").join(allowed.select(id_col), id_col, "left_semi")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), id_col))
    more = fresh.withColumn("rn", rank).join(need, stratum).where(F.col("rn") <= F.col("need"))
    return kept.select(id_col, stratum, F.lit(True).alias("kept")).unionByName(more.select(id_col, stratum, F.lit(False).alias("kept")))


def interleaved(rows: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first n rows, one of each source in turn."""
    rn = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return rows.select(source, order, rn.alias("rn")).where(F.col("rn") <= n).orderBy("rn", source).limit(n)


def adjacent_excerpts(items: DataFrame, group: str, order: str, text: str, tail: int, head: int) -> DataFrame:
    """The end of each item's predecessor beside the item's own beginning."""
    before = F.lag(text).over(Window.partitionBy(group).orderBy(order))
    return items.select(group, order, F.expr(f"right(lag({text}) over (partition by {group} order by {order}), {tail})").alias("tail"), F.substring(text, 1, head).alias("head"), before.alias("b")).where("b is not null").drop("b")


def kept_order(rows: DataFrame, group: str, order: str, value: str, sep: str = "|") -> DataFrame:
    """group, kept: each group's distinct trimmed non-empty values by first place, joined. Grouped by value first."""
    first = rows.select(group, F.trim(value).alias("v"), order).where("v <> ''").groupBy(group, "v").agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), sep).alias("kept"))


def first_ids(parents: DataFrame, dependents: DataFrame, id_col: str, n: int, offset: int = 0) -> DataFrame:
    """The dependents of the n parents that follow the first `offset` in order of their distinct ids."""
    return dependents.join(parents.select(id_col).distinct().orderBy(id_col).offset(offset).limit(n), id_col, "left_semi")


def first_text(*columns: Column) -> Column:
    """The first column that is not empty when trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
