"""Segments by similarity, entity names, relations of near pairs, degree-capped edges, named sources and checked decisions.

`segments` and `capped_degree` decide row by row in order. They run over sorted partitions that hold whole groups and carry a small state
from batch to batch, so a group of any length is streamed, not held.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import contained_in
from .tables import written

# Words that name nothing, words skipped inside names, and the pattern of a proper name.
STOP = (
    "about after again against also among another article because been before being between could from have into more most news only "
    "other over report said says some such than that their them then there these they this those through title under very what when "
    "where which while with would your"
).split()
JOINING = ["the", "of", "and"]
PROPER = r"\b(?:[A-Z]{2,}|[A-Z][A-Za-z0-9'’.-]+)(?:\s+(?:(?:of|the|and)\s+)?(?:[A-Z]{2,}|[A-Z][A-Za-z0-9'’.-]+)){0,4}\b"


def _in_order(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.repartition(group).sortWithinPartitions(group, *order)


class _OpenSegment:
    """The segment being filled and the one before it, which waits in case a tail joins it."""

    def __init__(self, group):
        self.group, self.number, self.ids, self.total, self.before = group, 0, [], 0.0, []

    def breaks(self, vec, most: int, least: int, similarity: float) -> bool:
        size = np.linalg.norm(self.total)
        alike = round(float(vec @ self.total / size), 9) if size > 0 else 0.0
        return len(self.ids) >= most or (len(self.ids) >= least and alike < similarity)

    def add(self, i, vec) -> None:
        self.ids.append(i)
        self.total = self.total + vec

    def closed(self) -> list:
        """Starts the next segment; gives the rows that no tail can join any more."""
        done = [(self.group, i, self.number - 1) for i in self.before]
        self.before, self.ids, self.total, self.number = self.ids, [], 0.0, self.number + 1
        return done

    def finished(self, most: int, tail: bool) -> list:
        joins = tail and len(self.ids) == 1 and 0 < len(self.before) < most
        return [(self.group, i, self.number - 1) for i in self.before] + [(self.group, i, self.number - joins) for i in self.ids]


def segments(rows: DataFrame, most: int, least: int, similarity: float, tail: bool) -> DataFrame:
    """group, id, segment: consecutive vectors of a group, in id order, cut where one is less similar to the segment's centroid.

    rows as `search.vectors` makes them; rows without group take no part. A segment has at most `most` vectors and is not cut below
    `least`. With `tail` a last segment of one vector joins the one before it if that has room. A zero centroid has similarity 0.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = _OpenSegment(None)
        for batch in batches:
            out = []
            for group, i, vec in zip(batch["group"], batch["id"], batch["vec"]):
                if group != now.group:
                    out += now.finished(most, tail)
                    now = _OpenSegment(group)
                elif now.breaks(vec, most, least, similarity):
                    out += now.closed()
                now.add(i, vec)
            yield pd.DataFrame(out, columns=["group", "id", "segment"])
        yield pd.DataFrame(now.finished(most, tail), columns=["group", "id", "segment"])

    sorted_rows = _in_order(rows.where("group is not null").select("group", "id", "vec"), "group", F.col("id"))
    return sorted_rows.mapInPandas(cut, "group string, id long, segment int")


def entity_aliases(text: Column) -> Column:
    """array<string>: how the proper names of a text may be called: the phrase, its initials, its last word; a single word of 4 letters or more.

    Names are of Latin letters; word boundaries are those of Unicode, so a name does not start or end beside another letter.
    """
    lower = lambda w: F.lower(w)
    parts = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PROPER), F.lit(0)),
        lambda m: F.filter(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: ~lower(w).isin(JOINING)),
    )

    def names(c: Column) -> Column:
        last = F.element_at(c, -1)
        long = F.array(lower(F.array_join(c, " ")), lower(F.array_join(F.transform(c, lambda w: F.substring(w, 1, 1)), "")))
        several = F.when(F.length(last) >= 5, F.concat(long, F.array(lower(last)))).otherwise(long)
        one = F.when((F.length(c[0]) >= 4) & ~lower(c[0]).isin(STOP), F.array(lower(c[0])))
        return F.when(F.size(c) > 1, several).when(F.size(c) == 1, F.coalesce(one, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(parts, names)))


def aliases(docs: DataFrame, id_col: str, text: str, share: float = 0.08, least_cap: int = 16) -> DataFrame:
    """id, alias, df: the aliases of each whole text that at most max(16, 8 %) of the documents have."""
    n = docs.agg(F.greatest(F.lit(least_cap), F.floor(F.count("*") * share)).alias("most"))
    each = written(docs.select(id_col, F.explode(entity_aliases(F.col(text))).alias("alias")))  # the names are looked for once
    df = each.groupBy("alias").agg(F.count("*").alias("df")).crossJoin(n).where("df <= most").drop("most")  # one row on the right
    return each.join(df, "alias").select(id_col, "alias", "df")


def related_pairs(pairs: DataFrame, entities: DataFrame, salient: DataFrame, least: float = 0.43) -> DataFrame:
    """a, b, score, relation, n_entities, n_terms of near pairs (a, b, score) that share entities (id, alias) or salient terms (id, term).

    same_entity_event: a shared entity, and a shared term or 0.68; else same_attribute: a shared term and 0.58. Other pairs are left out.
    """
    listed = lambda rows, c, name: rows.groupBy("id").agg(F.collect_set(c).alias(name))
    known = listed(entities, "alias", "entities").join(listed(salient, "term", "terms"), "id", "full_outer")
    side = lambda s: known.select(F.col("id").alias(s), F.col("entities").alias(f"e_{s}"), F.col("terms").alias(f"t_{s}"))
    both = pairs.where(F.col("score") >= least).join(side("a"), "a", "left").join(side("b"), "b", "left")
    shared = lambda x: F.coalesce(F.size(F.array_intersect(f"{x}_a", f"{x}_b")), F.lit(0))
    both = both.withColumn("n_entities", F.greatest(shared("e"), F.lit(0))).withColumn("n_terms", F.greatest(shared("t"), F.lit(0)))
    entity = (F.col("n_entities") > 0) & ((F.col("n_terms") > 0) | (F.col("score") >= 0.68))
    attribute = (F.col("n_terms") > 0) & (F.col("score") >= 0.58)
    relation = F.when(entity, "same_entity_event").when(attribute, "same_attribute")
    return both.select("a", "b", "score", relation.alias("relation"), "n_entities", "n_terms").where("relation is not null")


def narrative_pairs(pairs: DataFrame, events: DataFrame, entities: DataFrame, salient: DataFrame, most: int = 3) -> DataFrame:
    """group, a, b, score, n_entities, n_terms: pairs (a, b, score) of events of one group that depend on each other across scenes.

    events: id, group, place, scene. A pair is more than one place apart and in two scenes; it shares an entity at 0.58 and a salient term (or 0.70 without one), or two salient terms at
    0.66. Of these the strongest are kept while both ends have fewer than `most`; ties go to the smaller a, then b. Pairs with unknown events take no part.
    """
    side = lambda s: events.select(F.col("id").alias(s), F.col("group").alias(f"g_{s}"), F.col("place").alias(f"p_{s}"), F.col("scene").alias(f"s_{s}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").where("g_a = g_b AND s_a <> s_b AND abs(p_a - p_b) > 1")
    listed = lambda rows, c, name: rows.groupBy("id").agg(F.collect_set(c).alias(name))
    known = listed(entities, "alias", "entities").join(listed(salient, "term", "terms"), "id", "full_outer")
    of = lambda s: known.select(F.col("id").alias(s), F.col("entities").alias(f"e_{s}"), F.col("terms").alias(f"t_{s}"))
    both = apart.join(of("a"), "a", "left").join(of("b"), "b", "left")
    shared = lambda x: F.greatest(F.coalesce(F.size(F.array_intersect(f"{x}_a", f"{x}_b")), F.lit(0)), F.lit(0))
    both = both.select(F.col("g_a").alias("group"), "a", "b", "score", shared("e").alias("n_entities"), shared("t").alias("n_terms"))
    entity = (F.col("n_entities") > 0) & (F.col("score") >= 0.58) & ((F.col("n_terms") > 0) | (F.col("score") >= 0.70))
    both = both.where(entity | ((F.col("n_terms") >= 2) & (F.col("score") >= 0.66)))
    return both.join(capped_degree(both, "group", most).select("a", "b"), ["a", "b"], "left_semi")


def capped_degree(edges: DataFrame, group: str, most: int) -> DataFrame:
    """group, a, b, score of the edges that are kept: inside a group strongest first, while both ends have fewer than `most`.

    Ties go to the smaller a, then b. Rows with nulls take no part. The state is one count for each node of the group at hand.
    """
    schema = dict(edges.dtypes)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group_now, degree = None, Counter()
        for batch in batches:
            kept = np.zeros(len(batch), dtype=bool)
            for at, (g, a, b) in enumerate(zip(batch[group], batch["a"], batch["b"])):
                if g != group_now:
                    group_now, degree = g, Counter()
                if degree[a] < most and degree[b] < most:
                    kept[at] = True
                    degree[a] += 1
                    degree[b] += 1
            yield batch[kept]

    rows = _in_order(edges.select(group, "a", "b", "score").dropna(), group, F.desc("score"), F.col("a"), F.col("b"))
    return rows.mapInPandas(keep, f"{group} {schema[group]}, a {schema['a']}, b {schema['b']}, score {schema['score']}")


def normal_phrase(text: Column) -> Column:
    """Lower-cased runs of Latin letters and digits, joined by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def source_aliases(name: Column) -> Column:
    """array<string>: a source's name, the part before "|" and before " - ", all without a leading "the" too; of 3 characters or more."""
    parts = F.array(name, F.substring_index(name, "|", 1), F.substring_index(name, " - ", 1))
    phrases = F.transform(parts, normal_phrase)
    bare = F.transform(F.filter(phrases, lambda p: p.startswith("the ")), lambda p: F.substring(p, F.lit(5), F.length(p)))
    return F.array_distinct(F.filter(F.concat(phrases, bare), lambda p: F.length(p) >= 3))


def mentioned_sources(queries: DataFrame, sources: DataFrame, q_id: str, text: str, name: str) -> DataFrame:
    """query, alias, sources: aliases that a query's text names as whole phrases, without those inside a longer one that it names.

    sources: how many distinct source names have the alias.
    """
    named = sources.select(F.col(name).alias("name")).distinct().select("name", F.explode(source_aliases(F.col("name"))).alias("alias"))
    counted = named.groupBy("alias").agg(F.count("*").alias("sources"))
    claims = counted.select(F.col("alias").alias("id"), F.col("alias").alias("phrase"))
    texts = queries.select(F.col(q_id).alias("query"), normal_phrase(F.col(text)).alias("phrase"))
    found = contained_in(claims, texts, "id", "query", "phrase").groupBy(F.col("source").alias("query")).agg(F.collect_set("claim").alias("all"))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    outer = F.filter("all", lambda x: ~F.exists("all", lambda y: (y != x) & F.contains(padded(y), padded(x))))
    return found.select("query", F.explode(outer).alias("alias")).join(counted, "alias").select("query", "alias", "sources")


def checked_decisions(candidates: DataFrame, decisions: DataFrame, keys: list[str], kinds: list[str], continuity: str) -> DataFrame:
    """keys, source, verdict of each decision and of each candidate that had to be decided on and was not.

    candidates: keys, source, same_key; decisions: keys, source, kind, confidence, reason. Verdicts, the first that applies: unknown (no
    candidate), repeated (not the pair's only decision), kind (none of `kinds`), continuity (a same-key source needs that kind), confidence
    (outside 0 to 1), reason (empty), accepted; missing: a same-key candidate without decision.
    """
    pair = [*keys, "source"]
    allowed = candidates.groupBy(*pair).agg(F.max(F.coalesce("same_key", F.lit(False))).alias("same_key"), F.lit(True).alias("known"))
    counts = decisions.groupBy(*pair).agg(F.count("*").alias("n"))
    rows = decisions.join(counts, pair).join(allowed, pair, "full_outer")
    verdict = (
        F.when(F.col("n").isNull(), F.when(F.col("same_key"), "missing"))
        .when(F.col("known").isNull(), "unknown")
        .when(F.col("n") > 1, "repeated")
        .when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "kind")
        .when(F.col("same_key") & (F.col("kind") != continuity), "continuity")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason")
        .otherwise("accepted")
    )
    return rows.select(*pair, verdict.alias("verdict")).where("verdict is not null")


def accepted_edges(verdicts: DataFrame, decisions: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, edge_type, relation, confidence of accepted decisions that are no edge yet: each becomes one once.

    verdicts: as `checked_decisions` gives them; decisions: keys, source, kind, confidence; edges: keys, source of the edges that are there.
    """
    pair = [*keys, "source"]
    accepted = verdicts.where("verdict = 'accepted'").select(*pair)
    fresh = decisions.join(accepted, pair, "left_semi").join(edges.select(*pair), pair, "left_anti")
    return fresh.select(*pair, F.lit("DEPENDENCY").alias("edge_type"), F.col("kind").alias("relation"), "confidence")
