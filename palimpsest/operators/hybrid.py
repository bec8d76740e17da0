"""Neighbourhood search, unions of candidate channels, views of a state, retrieval audits, coverage ledgers and rendered contexts.

Rows with a null query, item or id take no part unless a function says otherwise; null texts are empty; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from .folds import skip_pack
from .retrieval import capped, contained_in
from .search import centroids, nearest, scored_pairs


def neighbourhood_search(queries: DataFrame, rows: DataFrame, links: DataFrame, seeds: int = 16, cap: int = 3, k: int = 10) -> DataFrame:
    """query, id, group, origin, score, place: rows near the best ones by meaning, by place and by linked groups.

    queries and rows as `search.vectors` makes them, rows grouped by document; links: group, linked, edge. The nearest `seeds` rows have a
    bonus of 1 - (rank - 1) / 32; rows one or two places beside a seed 0.6 / distance; the best row of a document linked with a seed's half
    the edge. The greatest bonus counts: score = 0.65 row + 0.20 document + 0.15 bonus (9 places), at most `cap` rows of a document, ties to the smaller id.
    Linked documents are joined by document and cut to their best row in each task before the shuffle.
    """
    placed = rows.select("id", "group", F.row_number().over(Window.partitionBy("group").orderBy("id")).alias("p")).where("group is not null")
    first = nearest(queries, rows, seeds).select("query", "id", "rank").join(placed, "id")
    own = first.select("query", "id", F.lit("seed").alias("origin"), (1 - (F.col("rank") - 1) / 32).alias("bonus"))
    steps = first.select("query", "group", "p", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("d"))
    beside = steps.select("query", "group", (F.col("p") + F.col("d")).alias("p"), (0.6 / F.abs("d")).alias("bonus"))
    beside = beside.join(placed, ["group", "p"]).select("query", "id", F.lit("neighbour").alias("origin"), "bonus")
    edges = first.select("query", "group").distinct().join(links, "group").groupBy("query", F.col("linked").alias("group")).agg(F.max("edge").alias("edge"))
    there = edges.join(placed.select("group", F.col("id").alias("doc")), "group").where("doc <> query")
    best = scored_pairs(there, queries, rows).groupBy("query", "group").agg(F.max(F.struct("dense", (-F.col("doc")).alias("at"))).alias("x"), F.max("edge").alias("edge"))
    linked = best.select("query", (-F.col("x.at")).alias("id"), F.lit("linked").alias("origin"), (F.greatest("edge", F.lit(0.0)) * 0.5).alias("bonus"))
    every = own.unionByName(beside).unionByName(linked).where("id <> query")
    pool = every.groupBy("query", F.col("id").alias("doc")).agg(F.max(F.struct("bonus", "origin")).alias("b"))
    near = scored_pairs(pool, queries, rows).withColumnRenamed("dense", "row_score")
    near = near.join(placed.select(F.col("id").alias("doc"), "group"), "doc").select("query", F.col("doc").alias("id"), "group", "b", "row_score")
    near = scored_pairs(near.withColumn("doc", F.col("group").cast("long")), queries, centroids(rows))
    score = F.round(0.65 * F.col("row_score") + 0.20 * F.col("dense") + 0.15 * F.col("b.bonus"), 9)
    scored = near.select("query", "id", "group", F.col("b.origin").alias("origin"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    kept = capped(scored.withColumn("rank", rank), "query", "id", "group", "rank", cap, k)
    return kept.join(scored.select("query", "id", "origin", "score"), ["query", "id"])


def retrieval_audit(selected: DataFrame, dense: DataFrame) -> DataFrame:
    """metric, value: what a retrieval (query, id, origin) changed against another (query, id).

    queries, changed (other ids), mean_jaccard (6 places) over the queries of the first; and origin:<name>, its rows by origin.
    """
    ours = selected.select("query", "id").distinct().withColumn("ours", F.lit(1))
    theirs = dense.join(ours.select("query").distinct(), "query", "left_semi").select("query", "id").distinct().withColumn("theirs", F.lit(1))
    of_query = ours.join(theirs, ["query", "id"], "full_outer").groupBy("query").agg(F.sum(F.col("ours") * F.col("theirs")).alias("both"), F.count("*").alias("any"))
    both = F.coalesce("both", F.lit(0))
    total = of_query.agg(
        F.count("*").cast("double").alias("queries"),
        F.count(F.when(both < F.col("any"), 1)).cast("double").alias("changed"),
        F.round(F.avg(both / F.col("any")), 6).alias("mean_jaccard"),
    )
    origins = selected.groupBy(F.concat(F.lit("origin:"), F.coalesce("origin", F.lit(""))).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return total.unpivot([], ["queries", "changed", "mean_jaccard"], "metric", "value").union(origins)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the lower-cased text without white space."""
    chars = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+", ""), "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda x, y: F.concat(x, y))  # the last has no second character: null
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared bigrams over those of the side that has fewer, 6 places; 0 if one has none."""
    least = F.least(F.size(a), F.size(b))
    return F.coalesce(F.round(F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0)), 6), F.lit(0.0))


def union_ranked(channels: dict[str, DataFrame], features: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys, source, channels, fused, rank: sources that any channel proposes for a target, the first `limit` by fused score.

    channels: name to frame (keys, source); features of every pair that may occur: keys, source, semantic, task, gap, same_key.
    fused = 0.5 semantic + 0.3 task + 0.2 / (1 + gap) + 0.5 for the same key, at most 1, 9 places. Ties: semantic, task, the smaller gap, source.
    """
    pair = [*keys, "source"]
    named = None
    for name, rows in channels.items():
        one = rows.select(*pair, F.lit(name).alias("channel"))
        named = one if named is None else named.unionByName(one)
    named = named.groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    same = F.coalesce("same_key", F.lit(False))
    task = F.when(same, 1.0).otherwise(F.col("task"))
    fused = F.round(F.least(F.lit(1.0), 0.5 * F.col("semantic") + 0.3 * task + 0.2 / (1 + F.col("gap")) + F.when(same, 0.5).otherwise(0.0)), 9)
    both = named.join(features, pair).withColumn("task", task).withColumn("fused", fused)
    order = [F.desc("fused"), F.desc("semantic"), F.desc("task"), F.asc("gap"), F.asc("source")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit).select(*pair, "channels", "fused", "rank")


def state_view(rows: DataFrame, view: str, key: str, hit: Column, overlap: Column, active: Column, importance: Column, recency: Column, size: Column, budget: int, limit: int) -> DataFrame:
    """view, key, used: at most `limit` rows of a view within `budget`; a row that does not fit is left out and the next is tried.

    Ranked by a named entity, overlap with the source (9 places), being active, importance, recency (all descending), then key.
    """
    order = [(~F.coalesce(hit, F.lit(False))).cast("int"), F.round(1 - F.coalesce(overlap, F.lit(0.0)), 9), (~F.coalesce(active, F.lit(False))).cast("int"), -importance, -recency, F.col(key)]
    return skip_pack(rows, view, order, key, size, budget, limit)


def _tagged(item: Column, text: Column) -> Column:
    """The squeezed text with every word marked by its item, so that texts of different items share no word."""
    return F.array_join(F.transform(F.filter(F.split(squeezed(text), " "), lambda w: w != ""), lambda w: F.concat(item.cast("string"), F.lit("\x01"), w)), " ")


def found_within(phrases: DataFrame, texts: DataFrame, item: str, p_id: str, t_id: str) -> DataFrame:
    """item, p_id, t_id: the texts (item, t_id, text) of an item that hold a phrase (item, p_id, text) of that item as whole words.

    A phrase and a text meet by the phrase's first words, not by their item: an item that holds much of the table is no group of pairs.
    """
    side = lambda rows, i: rows.where(F.col(item).isNotNull()).select(F.struct(item, i).alias("id"), _tagged(F.col(item), F.col("text")).alias("text"))
    found = contained_in(side(phrases, p_id), side(texts, t_id), "id", "id", "text", 3)
    return found.select(F.col(f"claim.{item}").alias(item), F.col(f"claim.{p_id}").alias(p_id), F.col(f"source.{t_id}").alias(t_id))


def dependency_recall(items: DataFrame, edges: DataFrame, nodes: DataFrame, gold: DataFrame, item: str) -> DataFrame:
    """item, n_gold, n_hit, recall, basis of every item: gold pairs that some predicted edge holds.

    edges: item, source, target (node ids); nodes: item, node, text; gold: item, n, source, target (texts). An end without a node's text
    is its own text. A pair is hit if one edge's source text holds the gold source and its target text the gold target, as whole words
    of lower-cased texts; an empty gold target asks for the source only, an empty gold source is never hit. No gold: recall 1, basis
    no_gold; no edges: 0, empty; else literal.
    """
    ends = edges.select(item, F.col("source").alias("node")).union(edges.select(item, "target")).distinct()
    known = nodes.where("text <> ''").select(item, "node", "text")
    texts = ends.join(known, [item, "node"], "left").select(item, "node", F.coalesce("text", F.col("node").cast("string")).alias("text"))
    side = lambda c: found_within(gold.select(item, "n", F.col(c).alias("text")), texts, item, "n", "node")
    on_edge = side("source").withColumnRenamed("node", "source").join(edges, [item, "source"]).select(item, "n", "target").distinct()
    whole = on_edge.join(side("target").withColumnRenamed("node", "target"), [item, "n", "target"], "left_semi").select(item, "n")
    open_end = on_edge.join(gold.where(squeezed(F.col("target")) == "").select(item, "n"), [item, "n"], "left_semi").select(item, "n")
    count = lambda rows, name: rows.groupBy(item).agg(F.count("*").alias(name))
    out = items.select(item).distinct()
    for rows, name in ((gold, "n_gold"), (edges, "n_edges"), (whole.union(open_end).distinct(), "n_hit")):
        out = out.join(count(rows, name), item, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    none, empty = F.col("n_gold") == 0, F.col("n_edges") == 0
    recall = F.when(none, 1.0).when(empty, 0.0).otherwise(F.col("n_hit") / F.col("n_gold"))
    return out.select(item, "n_gold", "n_hit", recall.alias("recall"), F.when(none, "no_gold").when(empty, "empty").otherwise("literal").alias("basis"))


def coverage(wanted: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """query, n, kind, item, hits: how many of a query's texts (query, node, text) hold each wanted item (query, n, kind, item)."""
    found = found_within(wanted.select(query, "n", F.col("item").alias("text")), texts, query, "n", "node")
    hits = found.groupBy(query, "n").agg(F.count("*").alias("hits"))
    return wanted.join(hits, [query, "n"], "left").select(query, "n", "kind", "item", F.coalesce("hits", F.lit(0)).alias("hits"))


def coverage_status(ledger: DataFrame, needed: DataFrame, query: str) -> DataFrame:
    """query, scope_complete, anchor_complete, status of each row of `needed` (query, needed: the answer has to see all evidence).

    complete: all scope items have hits, and all anchors if there are any; else partial. Without scope items nothing is complete.
    """
    all_of = lambda kind: F.coalesce(F.bool_and(F.when(F.col("kind") == kind, F.col("hits") > 0)), F.lit(False))
    anchors = F.count(F.when(F.col("kind") == "anchor", 1)).alias("anchors")
    each = ledger.groupBy(query).agg(all_of("scope").alias("scope_complete"), all_of("anchor").alias("anchor_complete"), anchors)
    out = needed.select(query, "needed").join(each, query, "left").fillna(False, ["scope_complete", "anchor_complete"])
    ready = F.col("scope_complete") & (F.col("anchor_complete") | (F.coalesce("anchors", F.lit(0)) == 0))
    status = F.when(~F.coalesce("needed", F.lit(False)), "not_required").when(ready, "complete").otherwise("partial")
    return out.select(query, "scope_complete", "anchor_complete", status.alias("status"))


def least_acted_option(labels: DataFrame, actions: DataFrame, query: str) -> DataFrame:
    """query, option, n_actions: of the options whose items all have label hits, the one with the fewest action hits.

    labels and actions: query, option, item, hits. Queries with fewer than two such options, or a tie, have no row.
    """
    whole = labels.groupBy(query, "option").agg(F.bool_and(F.coalesce("hits", F.lit(0)) > 0).alias("whole")).where("whole")
    acted = actions.groupBy(query, "option").agg(F.sum("hits").alias("n_actions"))
    each = whole.join(acted, [query, "option"], "left").select(query, "option", F.coalesce("n_actions", F.lit(0)).alias("n_actions"))
    least = each.groupBy(query).agg(F.count("*").alias("n"), F.min("n_actions").alias("n_actions")).where("n >= 2").drop("n")
    first = each.join(least, [query, "n_actions"]).groupBy(query, "n_actions").agg(F.count("*").alias("n"), F.min("option").alias("option"))
    return first.where("n = 1").select(query, "option", "n_actions")


def rendered(nodes: DataFrame, edges: DataFrame, target: str, header: str, budget: int) -> DataFrame:
    """target, text, n_nodes, n_edges: node lines (target, node, place, line) in order within `budget` characters, then relations.

    The first line that would cross the budget is cut to what remains less 4 and ends in "...", if over 80 characters remain; no line
    comes after it. Relations (target, source, end, kind) among all the given nodes follow by source, end and kind, while they fit.
    Only what fits is gathered.
    """
    used = F.sum(F.length("line")).over(Window.partitionBy(target).orderBy("place", "node").rowsBetween(Window.unboundedPreceding, 0)) + len(header)
    lines = nodes.withColumn("used", used).withColumn("left", budget - F.col("used") + F.length("line"))
    cut = F.concat(F.substring("line", F.lit(1), F.col("left") - 4), F.lit("...\n"))
    shown = lines.where((F.col("used") <= budget) | (F.col("left") > 80)).withColumn("whole", F.col("used") <= budget)
    shown = shown.select(target, "place", "node", "used", "whole", F.when(F.col("whole"), F.col("line")).otherwise(cut).alias("line"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "")
    body = shown.groupBy(target).agg(
        joined(F.struct("place", "node", "line")).alias("body"),
        F.coalesce(F.max(F.when(F.col("whole"), F.col("used"))), F.lit(len(header))).alias("used"),
        F.count("*").alias("n_nodes"),
    )
    label = "Relations:\n"
    for end in ("source", "end"):
        edges = edges.join(nodes.select(target, F.col("node").alias(end)), [target, end], "left_semi")
    line = F.concat(F.lit("- "), "source", F.lit(" -"), "kind", F.lit("-> "), "end", F.lit("\n"))
    total = F.sum(F.length("line")).over(Window.partitionBy(target).orderBy("source", "end", "kind").rowsBetween(Window.unboundedPreceding, 0))
    related = edges.withColumn("line", line).withColumn("total", total).join(body.select(target, "used"), target)
    related = related.where(F.col("used") + len(label) + F.col("total") <= budget)
    tail = related.groupBy(target).agg(joined(F.struct("source", "end", "kind", "line")).alias("tail"), F.count("*").alias("n_edges"))
    text = F.concat(F.lit(header), "body", F.when(F.col("tail").isNotNull(), F.concat(F.lit(label), "tail")).otherwise(""))
    return body.join(tail, target, "left").select(target, F.substring(text, 1, budget).alias("text"), "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def catalogue_graph(apis: DataFrame, graph: str) -> DataFrame:
    """graph, source, target, edge_type, reason of a catalogue (graph, api, required, optional: arrays of parameter names).

    The stage holds the query and each API, an API depends on the query, holds its parameters and depends on none; each parameter is
    numbered over required then optional ones and depends on its API. Null arrays are empty.
    """
    none = F.array().cast("array<string>")
    kinds = lambda c, kind: F.transform(F.coalesce(c, none), lambda p: F.struct(p.alias("name"), F.lit(kind).alias("kind")))
    listed = F.concat(kinds(F.col("required"), "required"), kinds(F.col("optional"), "optional"))
    api = F.concat(F.lit("api:"), "api")
    param = F.concat(F.lit("param:"), "api", F.lit("."), F.col("i") + 1, F.lit("."), "p.name")
    params = apis.select(graph, "api", F.posexplode(listed).alias("i", "p"))
    edge = lambda rows, s, t, kind, reason: rows.select(graph, s.alias("source"), t.alias("target"), F.lit(kind).alias("edge_type"), reason.alias("reason"))
    stage, query, nothing = F.lit("stage"), F.lit("query"), F.lit("")
    parts = [
        edge(apis.select(graph).distinct(), stage, query, "INCLUSION", nothing),
        edge(apis, stage, api, "INCLUSION", nothing),
        edge(apis, api, query, "DEPENDENCY", F.lit("available")),
        edge(params, api, param, "INCLUSION", nothing),
        edge(params, param, api, "DEPENDENCY", F.col("p.kind")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


def renamed_by_position(reference: DataFrame, candidate: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """query, id, text, n_names, verdict: texts (query, id, text) in which a candidate's names are replaced by the reference's.

    reference and candidate: query, position, schema, name; names pair by position. Verdicts, the first that applies: count (other
    positions), schema (another schema at some position), ambiguous (one name for several), renamed, equal (no name differs). Only renamed
    texts change: all names at once, longer names first where two begin at one place. Queries with no table are equal.
    """
    side = lambda rows, s: rows.select(query, "position", F.col("schema").alias(f"{s}_schema"), F.col("name").alias(f"{s}_name"), F.lit(True).alias(s))
    paired = side(reference, "r").join(side(candidate, "c"), [query, "position"], "full_outer")
    names = paired.where("c_name <> r_name").groupBy(query, "c_name").agg(F.min("r_name").alias("r_name"))
    several = paired.where("r and c").groupBy(query, "c_name").agg(F.countDistinct("r_name").alias("m")).groupBy(query).agg(F.max("m").alias("m"))
    checked = paired.groupBy(query).agg(F.bool_or(F.col("r").isNull() | F.col("c").isNull()).alias("count"), F.bool_or(~F.col("r_schema").eqNullSafe(F.col("c_schema"))).alias("schema"))
    longest = F.array_sort(F.collect_list(F.struct((-F.length("c_name")).alias("n"), "c_name", "r_name")))
    changed = names.where("c_name <> ''").groupBy(query).agg(longest.alias("names"))
    verdict = F.when(F.col("count"), "count").when(F.col("schema"), "schema").when(F.col("m") > 1, "ambiguous").when(F.size("names") > 0, "renamed").otherwise("equal")
    of_query = checked.join(several, query, "left").join(changed, query, "left").select(query, verdict.alias("verdict"), "names")
    of_query = of_query.withColumn("names", F.when(F.col("verdict") == "renamed", F.col("names")))
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x["c_name"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.array_join(F.transform("names", quoted), "|")
    text = F.coalesce("text", F.lit(""))
    new = F.map_from_entries(F.transform("names", lambda x: F.struct(x["c_name"], x["r_name"])))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.element_at(new, m))
    woven = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = texts.select(query, "id", "text").join(of_query, query, "left")
    renamed = F.when(F.col("names").isNotNull(), woven).otherwise(text)
    return out.select(query, "id", renamed.alias("text"), F.coalesce(F.size("names"), F.lit(0)).alias("n_names"), F.coalesce("verdict", F.lit("equal")).alias("verdict"))
