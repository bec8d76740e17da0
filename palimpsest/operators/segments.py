"""Segmentation of texts into windows, packs and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def token_windows(docs: DataFrame, size: int, overlap: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, window (from 0), start, n_tokens, text, text_sha256: every `size` tokens, each window starting `size - overlap` after the last.

    Without overlap the windows partition the tokens; with overlap every start below the token count makes one.
    """
    step = size - overlap
    cut = docs.select(id_col, tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    cut = cut.select(id_col, "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))).alias("window", "start"))
    part = F.slice("t", F.col("start") + 1, size)
    out = cut.select(id_col, "window", "start", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))
    return out.withColumn("text_sha256", F.sha2("text", 256))


def char_windows(messages: DataFrame, size: int, overlap: int, *, group: str, order: str, text: Column) -> DataFrame:
    """group, window, start, body: fixed character windows over each group's ordered, newline-joined texts.

    The stride is size - overlap; a final remainder no longer than the overlap is dropped unless it is the only window. Null texts are left out with their newline.

    No group's text is put together: each text knows its place by a running sum, is cut at multiples of the stride in one pass, and its cuts go to the windows that cover them.
    """
    stride = size - overlap
    texts = messages.select(group, F.col(order).alias("_o"), text.alias("_t")).where("_t is not null")
    w = Window.partitionBy(group).orderBy("_o", "_t")
    piece = F.when(F.row_number().over(w) == 1, F.col("_t")).otherwise(F.concat(F.lit("\n"), "_t"))
    placed = texts.select(group, "_o", "_t", piece.alias("_piece"))
    before = F.coalesce(F.sum(F.length("_piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select(group, "_piece", before.alias("_at")).withColumn("_room", (F.lit(stride) - F.col("_at") % stride).cast("int"))
    rest = F.regexp_extract_all(F.substring("_piece", F.col("_room") + 1, F.length("_piece")), F.lit(f"(?s)(.{{1,{stride}}})"), F.lit(1))
    cut = placed.select(group, "_at", F.posexplode(F.concat(F.array(F.substring("_piece", F.lit(1), F.col("_room"))), rest)).alias("_i", "_x")).where("_x <> ''")
    cell = (F.floor(F.col("_at") / stride) + F.col("_i")).cast("long")
    cut = cut.select(group, F.when(F.col("_i") == 0, F.col("_at")).otherwise(cell * stride).alias("_at"), "_x", cell.alias("_cell"))
    first = F.greatest(F.lit(0).cast("long"), F.col("_cell") - (-(-size // stride) - 1))
    parts = cut.select(group, F.struct("_at", "_x").alias("_p"), F.explode(F.sequence(first, F.col("_cell"))).alias("_w"))
    bodies = parts.groupBy(group, "_w").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_x"]), "").alias("_b"))  # one window's characters
    out = bodies.select(group, F.col("_w").cast("int").alias("window"), (F.col("_w") * stride).cast("int").alias("start"), F.substring("_b", F.lit(1), F.lit(size)).alias("body"))
    return out.where((F.col("window") == 0) | (F.length("body") > overlap))


def session_blocks(messages: DataFrame, group: str, order: str, speaker: str, text: str) -> DataFrame:
    """group, n_turns, block: one ordered block `speaker: text` per line for each group."""
    line = F.concat(F.col(speaker), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    return messages.groupBy(group).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(ordered, lambda s: s["x"]), "\n").alias("block"))


def previous_tail(messages: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Each item with the tail of the item before it: at most `budget` tokens, their count, whether it was cut, and its digest."""
    before = F.lag(tokens(F.col(text))).over(Window.partitionBy(group).orderBy(order))
    out = messages.select(group, order, before.alias("p"))
    tail = F.slice("p", F.greatest(F.size("p") - budget + 1, F.lit(1)), budget)
    carried = F.when(F.size("p") > 0, F.array_join(tail, " "))
    return out.select(group, order, carried.alias("carried"), F.when(F.size("p") > 0, F.least(F.size("p"), F.lit(budget))).otherwise(0).alias("n_tokens"), F.coalesce(F.size("p") > budget, F.lit(False)).alias("cut"), F.sha2(carried, 256).alias("carried_sha256"))


def prefix_pack(items: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Items in order while the running token count, one separator each, stays within the budget; the item that crosses it is cut to fit."""
    t = items.select(group, order, tokens(F.col(text)).alias("t"))
    run = F.sum(F.size("t") + 1).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    t = t.withColumn("room", F.lit(budget) - (run - F.size("t"))).where(F.col("room") > 0)
    kept = F.least(F.size("t"), F.col("room")).cast("int")
    return t.where(F.size("t") > 0).select(group, order, kept.alias("n_tokens"), (F.size("t") > F.col("room")).alias("cut"), F.array_join(F.slice("t", F.lit(1), kept), " ").alias("packed"))


def newest_first(items: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The newest whole items that fit the budget together, with the tokens used from the newest on; the newest with tokens is cut to the budget."""
    t = items.select(group, order, F.size(tokens(F.col(text))).alias("n_tokens"))
    used = F.sum("n_tokens").over(Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    packed = t.withColumn("used", used).where((F.col("used") <= budget) | (F.col("used") == F.col("n_tokens")))
    return packed.select(group, order, F.least("n_tokens", F.lit(budget)).alias("n_tokens"), F.least("used", F.lit(budget).cast("long")).alias("used"))


def newest_as_of(items: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """For each item as_of: the newest whole items before its predecessor that fit the budget together, and the tokens used from the newest on.

    The newest of them with tokens always stays, cut to its last `budget` tokens if it alone has more; items without tokens are left out.
    Items meet by cells of running token sums as wide as the budget, so that a cell holds a bounded number of items of a group.
    """
    w = Window.partitionBy(group).orderBy(order)
    t = items.select(group, order, tokens(F.col(text)).alias("t")).withColumn("end", F.sum(F.size("t")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("begin", F.col("end") - F.size("t")).withColumn("newest", F.last(F.when(F.size("t") > 0, F.col("begin")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -2)))
    t = t.withColumn("total", F.lag("end", 2).over(w))
    cell = lambda c: F.floor(F.col(c) / (budget + 1))
    # from the newest item's cell, or the first that the budget reaches, on
    reach = F.least(F.col("newest"), F.greatest(F.col("total") - budget, F.lit(0)))
    asked = t.where("newest IS NOT NULL").select(group, F.col(order).alias("as_of"), "total", "newest", reach.alias("reach"))
    asked = asked.withColumn("cell", F.explode(F.array_distinct(F.array(cell("reach"), cell("newest")))))
    have = t.where(F.size("t") > 0).select(group, order, "t", "begin", cell("begin").alias("cell"))
    near = asked.join(have, [group, "cell"]).where((F.col("begin") <= F.col("newest")) & ((F.col("begin") == F.col("newest")) | (F.col("total") - F.col("begin") <= budget)))
    cut = F.size("t") > budget
    body = F.array_join(F.when(cut, F.slice("t", F.greatest(F.size("t") - budget + 1, F.lit(1)), budget)).otherwise(F.col("t")), " ")
    return near.select(group, "as_of", order, F.least(F.size("t"), F.lit(budget)).alias("n_tokens"), cut.alias("cut"), F.least(F.col("total") - F.col("begin"), F.lit(budget)).cast("long").alias("used"), body.alias("body"))


def trimmed(docs: DataFrame, id_col: str, text: str, most: int, marker: str) -> DataFrame:
    """Texts of more than `most` characters as head, marker and tail."""
    n, head = F.length(text), most // 2
    cut = F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(F.col(text), n - (most - head) + 1, F.lit(most - head)))
    return docs.select(id_col, (n > most).alias("cut"), F.when(n > most, cut).otherwise(F.col(text)).alias("body"))


def split_at_marker(text: Column, marker: str) -> tuple[Column, Column]:
    """What comes before the first marker, and what comes after; without a marker all of it comes before and nothing after."""
    at = F.locate(marker, text)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return head, F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(F.lit(""))


def marked_units(rows: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """id, place, body: each unit from a line that starts with the pattern up to the next one, trimmed; what comes before the first is no unit. Null and unmarked texts give no row."""
    parts = F.split(F.col(text), f"(?dm)(?=^(?:{pattern}))")
    marked = F.filter(parts, lambda x: x.rlike(f"^(?:{pattern})"))
    return rows.select(id_col, F.posexplode(marked).alias("place", "_x")).select(id_col, "place", F.trim(F.col("_x"), F.lit(" \n\t\r")).alias("body"))
