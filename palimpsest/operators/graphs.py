"""Graphs of nodes and edges built from tables, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .tables import written


def ordered_children(rows: DataFrame, parent: str, child: str, order: str) -> DataFrame:
    """source, target, edge_type: INCLUSION from each parent, MAINLINE between neighbouring children."""
    inclusion = rows.select(F.col(parent).alias("source"), F.col(child).alias("target"), F.lit("INCLUSION").alias("edge_type"))
    nxt = F.lead(child).over(Window.partitionBy(parent).orderBy(order, child))
    return inclusion.unionByName(rows.select(F.col(child).alias("source"), nxt.alias("target"), F.lit("MAINLINE").alias("edge_type")).where("target is not null"))


def state_runs(events: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """group, ordinal, key, n, first, last: runs of consecutive rows with one key, numbered from 1."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    runs = events.select(group, key, order, new.alias("new")).withColumn("ordinal", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "ordinal", key).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def dated_chain(rows: DataFrame, source: str, date: str, id_col: str) -> DataFrame:
    """source, target, days: each dated row and the next of its source; rows without a date take no part."""
    w = Window.partitionBy(source).orderBy(date, id_col)
    out = rows.where(F.col(date).isNotNull()).select(F.col(id_col).alias("source"), F.lead(id_col).over(w).alias("target"), F.datediff(F.lead(date).over(w), F.col(date)).alias("days"))
    return out.where("target is not null")


def salient_terms(docs: DataFrame, id_col: str, text: str, most: int = 18, share: float = 0.08, least_cap: int = 12) -> DataFrame:
    """id, term, df, rank: the rarest terms of each text among those of more than one text and of at most max(12, 8 %) of all."""
    n = docs.agg(F.count("*").alias("n"))
    exploded = docs.select(id_col, F.explode(terms(F.col(text))).alias("term"))
    counted = written(exploded.groupBy("term").agg(F.count("*").alias("df")).where("df > 1").crossJoin(n.select(F.greatest(F.lit(float(least_cap)), F.col("n") * share).alias("most"))))  # one row on the right
    # Terms of more texts than that make most of the rows, but there are at most 1 / share times the terms of a mean text: these go before anything is shuffled.
    exploded = exploded.join(F.broadcast(counted.where("df > most").select("term")), "term", "left_anti")
    df = counted.where("df <= most").drop("most")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("df", "term"))
    return exploded.join(df, "term").withColumn("rank", rank).where(F.col("rank") <= most).select(id_col, "term", "df", "rank")


def prior_related(items: DataFrame, group: str, order: str, text: str, shared: int = 2, top: int = 2) -> DataFrame:
    """group, order, prior, overlap: the earlier items of the group that share most terms, at least `shared`."""
    t = items.select(group, order, F.explode(terms(F.col(text), 3)).alias("term"))
    pairs = t.join(t.select(group, F.col(order).alias("prior"), "term"), [group, "term"]).where(F.col("prior") < F.col(order))
    counted = pairs.groupBy(group, order, "prior").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= shared)
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy(group, order).orderBy(F.desc("overlap"), F.desc("prior")))).where(F.col("rn") <= top).drop("rn")


def two_hop(edges: DataFrame, seeds: DataFrame, relations: list[str], floor: float = 0.45) -> DataFrame:
    """source, target, middle, weight: from each seed (node) the heaviest simple path of two undirected edges to each node it reaches so.

    edges: source, target, relation, weight. Only edges of the given relations count, each with at least the floor as its weight (null
    weights too); of parallel edges the heaviest stays. A path's weight is the product; ties go to the smaller middle. Loops and null ends
    take no part, and repeated seeds count once.
    """
    kept = edges.where(F.col("relation").isin(relations) & (F.col("source") != F.col("target")))
    weight = F.greatest(F.lit(floor), "weight").alias("weight")
    both = kept.select("source", "target", weight).union(kept.select("target", "source", weight)).groupBy("source", "target").agg(F.max("weight").alias("weight"))
    first = both.join(seeds.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select("source", F.col("target").alias("middle"), F.col("weight").alias("w1"))
    second = both.select(F.col("source").alias("middle"), "target", F.col("weight").alias("w2"))
    paths = first.join(second, "middle").where(F.col("target") != F.col("source"))
    best = paths.groupBy("source", "target").agg(F.min(F.struct((-F.round(F.col("w1") * F.col("w2"), 9)).alias("w"), "middle")).alias("m"))
    return best.select("source", "target", "m.middle", (-F.col("m.w")).alias("weight"))


def chain_neighbourhood(rows: DataFrame, seeds: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """group, order, distance: rows within k places of a seed on each group's chain."""
    p = rows.select(group, order, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("p"))
    s = p.join(seeds.select(group, order), [group, order], "left_semi").select(group, F.explode(F.sequence(F.col("p") - k, F.col("p") + k)).alias("p"), F.col("p").alias("s"))
    return p.join(s, [group, "p"]).groupBy(group, order).agg(F.min(F.abs(F.col("p") - F.col("s"))).alias("distance"))


def smallest_cover(events: DataFrame, group: str, order: str, key: str, anchors: list[str]) -> DataFrame:
    """group, start, end, length: the shortest stretch of each group's sequence that holds every anchor, ties to the earlier end."""
    w = Window.partitionBy(group).orderBy(order)
    p = events.select(group, key, F.row_number().over(w).alias("p"))
    running = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    p = p.select(group, "p", key, *[F.last(F.when(F.col(key) == a, F.col("p")), ignorenulls=True).over(running).alias(f"a{i}") for i, a in enumerate(anchors)])
    whole = p.where(F.col(key).isin(anchors) & F.concat(*[F.col(f"a{i}").cast("string") for i in range(len(anchors))]).isNotNull())
    spans = whole.select(group, F.least(*[F.col(f"a{i}") for i in range(len(anchors))]).alias("start"), F.col("p").alias("end"))
    spans = spans.withColumn("length", F.col("end") - F.col("start") + 1)
    return spans.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("length", "end"))).where("rn = 1").drop("rn")


def profile(edges: DataFrame) -> DataFrame:
    """edge_type, n_edges, n_sources, n_targets for each type."""
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))


def neighbours(edges: DataFrame) -> DataFrame:
    """node, parent, previous, next, n_children: what INCLUSION and MAINLINE edges say of each node; one pass over the edges."""
    kind = lambda k, c: F.when(F.col("edge_type") == k, F.col(c))
    none = F.lit(None).cast("string")
    ahead = edges.select(F.col("source").alias("node"), none.alias("parent"), none.alias("previous"), kind("MAINLINE", "target").alias("next"), kind("INCLUSION", "target").alias("child"))
    behind = edges.select(F.col("target").alias("node"), kind("INCLUSION", "source").alias("parent"), kind("MAINLINE", "source").alias("previous"), none.alias("next"), none.alias("child"))
    return ahead.unionByName(behind).groupBy("node").agg(F.max("parent").alias("parent"), F.max("previous").alias("previous"), F.max("next").alias("next"), F.count("child").alias("n_children"))


def group_chain(rows: DataFrame, group: str, date: str, id_col: str, doc: str) -> DataFrame:
    """group, source, target: consecutive rows of groups with several documents, where the document changes."""
    w = Window.partitionBy(group).orderBy(date, id_col)
    out = rows.select(group, F.col(id_col).alias("source"), F.lead(id_col).over(w).alias("target"), F.col(doc).alias("d"), F.lead(doc).over(w).alias("e"))
    return out.where("d <> e").select(group, "source", "target")


def timeline(rows: DataFrame, parent: str, speaker: str, order: str) -> DataFrame:
    """source, target, edge_type: SPOKE from each speaker of a parent to its rows, NEXT between a speaker's rows in order."""
    row, who = F.concat_ws(":", parent, order), F.concat_ws(":", parent, speaker)
    rows = rows.select(who.alias("who"), row.alias("target"), F.lag(row).over(Window.partitionBy(parent, speaker).orderBy(order)).alias("before"))
    kinds = F.array(F.struct(F.col("who").alias("source"), "target", F.lit("SPOKE").alias("edge_type")), F.struct(F.col("before").alias("source"), "target", F.lit("NEXT").alias("edge_type")))
    return rows.select(F.inline(kinds)).where(F.col("source").isNotNull())


def category_tree(chunks: DataFrame, category: str, doc: str, chunk: str) -> DataFrame:
    """source, target, edge_type: CATEGORY to each document, CHUNK to each of a document's chunks. chunks has a row for each chunk."""
    of = chunks.select(F.col(category).cast("string").alias("source"), F.col(doc).cast("string").alias("target")).distinct().withColumn("edge_type", F.lit("CATEGORY"))
    return of.union(chunks.select(F.col(doc).cast("string"), F.concat_ws(":", doc, chunk), F.lit("CHUNK")))


def temporal_chain(rows: DataFrame, source: str, date: str, id_col: str) -> DataFrame:
    """source, earlier, later: neighbours among the dated rows of a source. Names of sources are compared by their lower-case letters and digits; rows without date take no part."""
    key = F.regexp_replace(F.lower(F.col(source).cast("string")), r"[^\p{L}\p{N}]", "")
    rows = rows.where(F.col(date).isNotNull()).select(key.alias("source"), date, F.col(id_col).alias("earlier"))
    return rows.withColumn("later", F.lead("earlier").over(Window.partitionBy("source").orderBy(date, "earlier"))).where(F.col("later").isNotNull()).drop(date)


def execution_graph(trace: DataFrame, stage: str, call: str, tool: str) -> DataFrame:
    """source, target, relation: stages include calls, calls produce observations, an observation feeds the stage's next call, tools serve stages."""
    prior = F.lag(call).over(Window.partitionBy(stage).orderBy(call))
    rows = trace.select(stage, call, tool, prior.alias("prior"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("relation"))
    out = edge(rows, name("stage", stage), name("call", call), "INCLUSION")
    out = out.union(edge(rows, name("call", call), name("observation", call), "PRODUCES"))
    out = out.union(edge(rows.where("prior is not null"), name("observation", "prior"), name("call", call), "DEPENDENCY"))
    return out.union(edge(rows, name("tool", tool), name("stage", stage), "CAPABILITY").distinct())


def edge_delta(old: DataFrame, new: DataFrame, declared: DataFrame) -> DataFrame:
    """source, target, change (removed or added, as multisets), declared: whether the change is in the declared ones (source, target, change)."""
    cols = ["source", "target"]
    gone, made = old.select(cols).exceptAll(new.select(cols)), new.select(cols).exceptAll(old.select(cols))
    changes = gone.withColumn("change", F.lit("removed")).union(made.withColumn("change", F.lit("added")))
    known = declared.select(*cols, "change", F.lit(True).alias("d")).distinct()
    return changes.join(known, [*cols, "change"], "left").select(*cols, "change", F.col("d").isNotNull().alias("declared"))


def rollup(rows: DataFrame, group: str, id_col: str, title: str, most: int) -> DataFrame:
    """group, n, first, last (ids) and the first `most` distinct titles by first id, joined; titles are grouped before they are listed."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last"))
    titles = rows.groupBy(group, title).agg(F.min(id_col).alias("at"))
    titles = titles.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("at"))).where(F.col("rn") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("at", title)))
    named = titles.groupBy(group).agg(F.array_join(F.transform(ordered, lambda s: s[title]), ",").alias(f"{title}s"))
    return sizes.join(named, group)


_SIDES = [("INCLUSION", "child", "parent"), ("MAINLINE", "next", "previous"), ("DEPENDENCY", "dependent", "dependency")]


def related(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, relation, other, level: all of a node's children, parents, neighbours on the main line and dependencies, with the other node's level, as rows.

    nodes (node, level), edges (source, target, edge_type): both ends of each edge in one pass; repeated edges count once, other types and rows with nulls not at all. An unlisted node has no level.
    """
    pair = lambda n, r, o: F.struct(F.col(n).alias("node"), F.lit(r).alias("relation"), F.col(o).alias("other"))
    both = None
    for kind, ahead, behind in _SIDES:
        two = F.when(F.col("edge_type") == kind, F.array(pair("source", ahead, "target"), pair("target", behind, "source")))
        both = two if both is None else F.coalesce(both, two)
    ends = edges.dropna(subset=["source", "target"]).select(F.explode(both).alias("x")).select("x.*").distinct()
    return ends.join(nodes.groupBy(F.col("node").alias("other")).agg(F.min("level").alias("level")), "other", "left").select("node", "relation", "other", "level")


def graph_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (level, edge_type, relation), name, n: counts of nodes by level, and of edges by type and by relation; an edge without relation counts under its type in lower case."""
    relation = F.coalesce("relation", F.lower("edge_type"))
    pairs = F.array(F.struct(F.lit("edge_type").alias("kind"), F.col("edge_type").alias("name")), F.struct(F.lit("relation").alias("kind"), relation.alias("name")))
    counted = edges.select(F.inline(pairs)).groupBy("kind", "name").agg(F.count("*").alias("n"))
    return counted.unionByName(nodes.groupBy(F.lit("level").alias("kind"), F.col("level").alias("name")).agg(F.count("*").alias("n")))
