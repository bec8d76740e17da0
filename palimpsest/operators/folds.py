"""Folds over ordered groups: rules in which what happens to a row depends on what was decided about the rows before it.

All of them are one `F.aggregate` over a group's ordered array, so no Python runs. A group is held by one task: these are for
lists of some dozens to thousands of rows (sentences of a text, turns, ranked hits), not for groups that grow with the table.
Null orders come first, null sizes count as 0, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], state: dict[str, Column], step: Callable, out: str) -> DataFrame:
    """group columns and `state` fields after the fold.

    Rows of a group are ordered by `order`, then by their values. `step(state, row)` gives the next state as a dict of columns; the field
    `out` collects what the fold puts out.
    """
    keys = {f"_{i}": c for i, c in enumerate(order)}
    items = F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in {**keys, **values}.items()])))
    start = F.struct(*[c.alias(k) for k, c in state.items()])
    merge = lambda s, r: F.struct(*[c.alias(k) for k, c in step(s, r).items()])
    return rows.groupBy(*group).agg(items.alias("_items")).select(*group, F.aggregate("_items", start, merge)[out].alias(out))


def greedy_groups(rows: DataFrame, group: str, order: str, size: Column, target: int, most: int, tail: int = 0, most_rows: int = 1 << 30) -> DataFrame:
    """group, order, unit, size: consecutive rows packed into units.

    A unit closes once it has `target`, or before the row that would take it beyond `most` or beyond `most_rows` rows. A last unit below
    `tail` joins the one before it.
    """
    value = F.coalesce(size.cast("long"), F.lit(0))
    kind = f"array<struct<o:{dict(rows.dtypes)[order]},unit:int,size:bigint>>"
    zero = {"unit": F.lit(0), "used": F.lit(0).cast("long"), "n": F.lit(0), "made": F.array().cast(kind)}

    def step(s, r):
        close = (s["n"] > 0) & ((s["used"] >= target) | (s["used"] + r["v"] > most) | (s["n"] >= most_rows))
        unit = s["unit"] + close.cast("int")
        row = F.struct(r["_0"].alias("o"), unit.alias("unit"), r["v"].alias("size"))
        return {
            "unit": unit,
            "used": F.when(close, r["v"]).otherwise(s["used"] + r["v"]),
            "n": F.when(close, F.lit(1)).otherwise(s["n"] + 1),
            "made": F.concat(s["made"], F.array(row)).cast(kind),
        }

    made = folded(rows, [group], [F.col(order)], {"v": value}, zero, step, "made")
    last = F.element_at("made", -1)["unit"]
    used = F.aggregate(F.filter("made", lambda x: x["unit"] == last), F.lit(0).cast("long"), lambda s, x: s + x["size"])
    made = made.withColumn("_last", last).withColumn("_join", (last > 0) & (used < tail))
    rows = made.select(group, "_last", "_join", F.explode("made").alias("m"))
    unit = F.col("m.unit") - (F.col("_join") & (F.col("m.unit") == F.col("_last"))).cast("int")
    return rows.select(group, F.col("m.o").alias(order), unit.alias("unit"), F.col("m.size").alias("size"))


def skip_pack(rows: DataFrame, group: str, order: list[Column], id_col: str, size: Column, budget: int, most_rows: int = 1 << 30) -> DataFrame:
    """group, id, used: at most `most_rows` rows in order while they fit the budget; one that does not fit is left out and the next is tried."""
    kind = f"array<struct<id:{dict(rows.dtypes)[id_col]},used:bigint>>"
    zero = {"used": F.lit(0).cast("long"), "kept": F.array().cast(kind)}

    def step(s, r):
        used = s["used"] + r["v"]
        fits = (used <= budget) & (F.size(s["kept"]) < most_rows)
        row = F.struct(r["id"].alias("id"), used.alias("used"))
        return {"used": F.when(fits, used).otherwise(s["used"]), "kept": F.when(fits, F.concat(s["kept"], F.array(row))).otherwise(s["kept"]).cast(kind)}

    values = {"id": F.col(id_col), "v": F.coalesce(size.cast("long"), F.lit(0))}
    kept = folded(rows, [group], order, values, zero, step, "kept")
    return kept.select(group, F.explode("kept").alias("k")).select(group, F.col("k.id").alias(id_col), F.col("k.used").alias("used"))


def diversified(hits: DataFrame, query: str, rank: str, item: str, group: str, text: Column, cap: int, k: int) -> DataFrame:
    """query, item, group, place: the first k hits with no text twice and at most `cap` of a group. A hit that the cap rejects blocks no later text."""
    types = dict(hits.dtypes)
    kind = f"array<struct<id:{types[item]},g:{types[group]},t:string>>"
    zero = {"kept": F.array().cast(kind)}

    def step(s, r):
        same = F.exists(s["kept"], lambda x: x["t"] == r["t"])
        of_group = F.size(F.filter(s["kept"], lambda x: x["g"].eqNullSafe(r["g"])))
        take = ~same & (of_group < cap) & (F.size(s["kept"]) < k)
        row = F.struct(r["id"].alias("id"), r["g"].alias("g"), r["t"].alias("t"))
        return {"kept": F.when(take, F.concat(s["kept"], F.array(row))).otherwise(s["kept"]).cast(kind)}

    values = {"id": F.col(item), "g": F.col(group), "t": F.coalesce(text, F.lit(""))}
    kept = folded(hits, [query], [F.col(rank)], values, zero, step, "kept").select(query, F.posexplode("kept").alias("p", "x"))
    return kept.select(query, F.col("x.id").alias(item), F.col("x.g").alias(group), (F.col("p") + 1).alias("place"))


def _bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def collapsed(blocks: DataFrame, group: str, id_col: str, text: Column, least: float = 0.72) -> DataFrame:
    """group, id, kept: longer blocks first, a block goes if a kept one equals it, contains it (8 characters or more) or has
    a Jaccard similarity of character bigrams of at least `least`. Ties in length go to the smaller id."""
    kind = f"array<struct<id:{dict(blocks.dtypes)[id_col]},t:string,b:array<string>,kept:boolean>>"
    zero = {"seen": F.array().cast(kind)}

    def step(s, r):
        def like(x):
            both, all_of = F.size(F.array_intersect(x["b"], r["b"])), F.size(F.array_union(x["b"], r["b"]))
            inside = (F.length(r["t"]) >= 8) & F.contains(x["t"], r["t"])
            return x["kept"] & ((x["t"] == r["t"]) | inside | (both >= least * F.greatest(all_of, F.lit(1))))

        row = F.struct(r["id"].alias("id"), r["t"].alias("t"), r["b"].alias("b"), (~F.exists(s["seen"], like)).alias("kept"))
        return {"seen": F.concat(s["seen"], F.array(row)).cast(kind)}

    blocks = blocks.select(group, id_col, F.coalesce(text, F.lit("")).alias("_t"))
    values = {"id": F.col(id_col), "t": F.col("_t"), "b": _bigrams(F.col("_t"))}
    seen = folded(blocks, [group], [-F.length("_t"), F.col(id_col)], values, zero, step, "seen")
    return seen.select(group, F.explode("seen").alias("x")).select(group, F.col("x.id").alias(id_col), F.col("x.kept").alias("kept"))
