"""Retrieval: lexical search, routing, dates and diversified lists."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, terms
from .tables import written

#: Terms of queries that one pass over the documents looks for; hits that a task holds before it keeps the best.
BLOCK_TERMS, HELD = 100_000, 500_000


def _pooled_terms(queries: DataFrame, q_id: str, text: str) -> DataFrame:
    """query, term: the distinct terms of each query id; rows without id or terms take no part."""
    q = queries.where(F.col(q_id).isNotNull()).select(F.col(q_id).alias("query"), F.explode(terms(F.col(text))).alias("term"))
    return q.distinct()


def _blocks(weighted: DataFrame) -> Iterator[list]:
    """The rows (query, term, weight) in lists of about BLOCK_TERMS, whole queries each, so that one list fits the driver and a worker."""
    n = -(-weighted.count() // BLOCK_TERMS)
    for i in range(n):
        yield weighted.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i).collect()


class _Best:
    """The k highest scores of each query, ties to the smaller doc. What comes is held until there is HELD of it, then cut down to the best."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, queries: np.ndarray, doc, scores: np.ndarray) -> None:
        self.parts.append((queries, np.full(len(queries), doc, dtype=object if isinstance(doc, str) else None), scores))
        self.held += len(queries)
        if self.held > HELD:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        queries, docs, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(docs, return_inverse=True)[1], -scores, queries))
        queries, docs, scores = queries[order], docs[order], scores[order]
        first = np.concatenate(([True], queries[1:] != queries[:-1]))
        place = np.arange(len(queries)) - np.maximum.accumulate(np.where(first, np.arange(len(queries)), 0))
        return queries[place < self.k], docs[place < self.k], scores[place < self.k]


def _best_of_partition(shared, k: int, whole: bool):
    """A function over batches (doc, body) that keeps each query's k documents of highest summed term weight. Its work and memory follow the hits, not documents x queries."""

    def scan(batches):
        ids: dict = {}
        of_term: dict = {}
        for query, term, weight in shared.value:
            of_term.setdefault(term, []).append((ids.setdefault(query, len(ids)), weight))
        lists = [(np.array([i for i, _ in x]), np.array([w for _, w in x], dtype=float)) for x in of_term.values()]
        number = {w: i for i, w in enumerate(of_term)}
        automaton = ahocorasick.Automaton()
        for w, i in number.items():
            automaton.add_word(w, i)
        automaton.make_automaton()
        best = _Best(k)
        for batch in batches:
            for doc, body in zip(batch["doc"].tolist(), batch["body"], strict=True):
                found = {number[w] for w in body if w in number} if whole else {i for _, i in automaton.iter(body)}
                if found:
                    at = sorted(found)
                    queries, inverse = np.unique(np.concatenate([lists[i][0] for i in at]), return_inverse=True)
                    best.add(queries, doc, np.round(np.bincount(inverse, np.concatenate([lists[i][1] for i in at])), 9))
        names = list(ids)
        queries, docs, scores = best.best()
        yield pd.DataFrame({"query": [names[i] for i in queries], "doc": docs, "score": scores})

    return scan


def _lexical(weighted: DataFrame, docs: DataFrame, d_id: str, body: Column, k: int, whole: bool) -> DataFrame:
    """query, doc, score, rank. Documents are read once for each block of queries; a task sends k rows of a query, not one for each document. Only hits of a positive weight count."""
    bodies = docs.where(F.col(d_id).isNotNull()).select(F.col(d_id).alias("doc"), body.alias("body"))
    schema = f"query {dict(weighted.dtypes)['query']}, doc {dict(bodies.dtypes)['doc']}, score double"
    found, weighted = docs.sparkSession.createDataFrame([], schema), written(weighted)
    for block in _blocks(weighted):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block])
        found = found.union(bodies.mapInPandas(_best_of_partition(shared, k, whole), schema))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def term_hits(queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, text: str, k: int, fall_back: bool = False) -> DataFrame:
    """query, doc, hits, rank: documents by the number of the query's terms that their lower-cased text holds, inside longer words too.

    With fall_back a query without any hit takes the last k documents, the last first, with 0 hits. Rows without id take no part;
    repeated query ids pool their terms, repeated documents are rows of their own.
    """
    asked = _pooled_terms(queries, q_id, text)
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = _lexical(asked.withColumn("weight", F.lit(1.0)), docs, d_id, lowered, k, False)
    found = found.select("query", "doc", F.col("score").cast("long").alias("hits"), "rank")
    if not fall_back:
        return found
    last = docs.where(F.col(d_id).isNotNull()).orderBy(F.desc(d_id)).limit(k).select(F.col(d_id).alias("doc"))
    last = last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("doc"))))  # k rows
    missed = queries.select(F.col(q_id).alias("query")).where("query is not null").distinct().join(found, "query", "left_anti")
    return found.union(missed.join(F.broadcast(last)).select("query", "doc", F.lit(0).cast("long").alias("hits"), "rank"))


def idf_routing(queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, text: str, k: int) -> DataFrame:
    """query, doc, score, rank: share of the query's idf mass, ln((N + 1) / (df + 1)) + 1 a term, that the document covers as words."""
    n = docs.agg(F.count("*").alias("n"))
    asked = _pooled_terms(queries, q_id, text)
    known = asked.select("term").distinct()
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(known, "term", "left_semi")
    weight = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    asked = asked.join(df, "term", "left").crossJoin(n).withColumn("idf", weight).drop("df", "n")  # one row on the right
    mass = asked.groupBy("query").agg(F.sum("idf").alias("mass"))
    weighted = asked.join(mass, "query").select("query", "term", (F.col("idf") / F.col("mass")).alias("weight"))
    return _lexical(weighted, docs, d_id, terms(F.col(text)), k, True)


def nearest_dated(queries: DataFrame, rows: DataFrame, key: str, q_id: str, q_date: str, r_id: str, r_date: str) -> DataFrame:
    """query, row, days: of the rows with the query's key, other than its own id, the one of the nearest date; ties to the smaller id.

    Rows and queries without key, id or date take no part; a row id repeated within a key counts at its first date. Each key's dates are
    passed in order once each way: with the two smallest ids of the two nearest dates on each side the query's own id can be left out.
    """
    r = rows.select(key, F.col(r_id).alias("row"), F.to_date(r_date).alias("d")).dropna().groupBy(key, "row").agg(F.min("d").alias("d"))
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy(key, "d").orderBy("row"))).where("rn <= 2")
    dates = r.groupBy(key, "d").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    along = Window.partitionBy(key).orderBy("d")
    here = F.struct("d", "a", "b")
    dates = dates.select(key, "d", F.array(here, F.lag(here).over(along)).alias("before"), F.array(here, F.lead(here).over(along)).alias("after"))
    q = queries.select(key, F.to_date(q_date).alias("d"), F.col(q_id).alias("query")).dropna()
    both = dates.unionByName(q, allowMissingColumns=True)
    is_query = F.col("query").isNotNull()
    latest = F.last("before", ignorenulls=True).over(Window.partitionBy(key).orderBy("d", is_query))
    soonest = F.last("after", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("d"), is_query))
    none = F.array().cast(both.schema["before"].dataType)
    seen = both.withColumn("x", latest).withColumn("y", soonest).where(is_query)
    other = lambda e: F.when(e["a"] != F.col("query"), e["a"]).otherwise(F.when(e["b"] != F.col("query"), e["b"]))
    ranked = F.transform(F.concat(F.coalesce("x", none), F.coalesce("y", none)), lambda e: F.struct(F.abs(F.datediff(F.col("d"), e["d"])).alias("days"), other(e).alias("row")))
    best = F.array_min(F.filter(ranked, lambda e: e["row"].isNotNull()))
    return seen.select("query", best.alias("m")).where("m is not null").select("query", "m.row", "m.days")


def capped(hits: DataFrame, query: str, item: str, group: str, rank: str, cap: int, k: int) -> DataFrame:
    """The first k hits of each query by rank with at most `cap` of a group."""
    first = hits.withColumn("g", F.row_number().over(Window.partitionBy(query, group).orderBy(rank))).where(F.col("g") <= cap)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(rank))).where(F.col("place") <= k).select(query, item, group, "place")


def ranking_metrics(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query, hit4, hit10, mrr10, ap10 of ranked hits (query, doc, rank) against gold pairs (query, doc)."""
    n = gold.groupBy("query").agg(F.count_distinct("doc").alias("n_gold"))
    found = hits.join(gold.select("query", "doc").distinct(), ["query", "doc"]).where("rank <= 10")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    per = found.groupBy("query").agg(F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("s"))
    out = n.join(per, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query", F.coalesce((F.col("first") <= 4).cast("int"), F.lit(0)).alias("hit4"), F.coalesce((F.col("first") <= 10).cast("int"), F.lit(0)).alias("hit10"), F.round(zero(1 / F.col("first")), 9).alias("mrr10"), F.round(zero(F.col("s") / F.least("n_gold", F.lit(10))), 9).alias("ap10"))


def contained_in(claims: DataFrame, sources: DataFrame, c_id: str, s_id: str, text: str, words: int = 6, most: int = 200_000) -> DataFrame:
    """claim, source: sources whose squeezed text contains the squeezed claim as whole words. Empty claims are in none.

    A claim and a source meet where the claim's head, its first `words` words (of a shorter claim: all), begins a run of the source.
    Sources send hashes of runs only, of those lengths that some head has; the heads are counted and broadcast up to `most`.
    """
    c = claims.select(F.col(c_id).alias("claim"), squeezed(F.col(text)).alias("c")).where("c <> ''")
    head = F.slice(F.split("c", " "), 1, words)
    c = c.select("claim", "c", F.size(head).alias("width"), F.xxhash64(F.array_join(head, " ")).alias("head"))
    widths = [r[0] for r in c.select("width").distinct().collect()]  # `words` values at most
    heads = c.select("head").distinct()
    w = F.split("s", " ")
    s = sources.select(F.col(s_id).alias("source"), squeezed(F.col(text)).alias("s")).where("s <> ''")

    def runs(n: int) -> Column:
        shifted = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)])
        return F.transform(shifted, lambda z: F.xxhash64(F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)])))

    none = F.array().cast("array<bigint>")
    grams = s.select("source", F.explode(F.array_distinct(F.concat(none, *[runs(n) for n in widths]))).alias("head"))
    met = grams.join(F.broadcast(heads) if heads.count() <= most else heads, "head", "left_semi")
    pairs = c.join(met, "head").select("claim", "c", "source").join(s, "source")
    return pairs.where(F.expr("contains(concat(' ', s, ' '), concat(' ', c, ' '))")).select("claim", "source").distinct()


def group_rank(rows: DataFrame, group: str, id_col: str, score: str) -> DataFrame:
    """group, best, mean_top, total: the best fragment's score plus a fifth of the mean of the three best; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col))
    top = rows.where(F.col(score).isNotNull()).withColumn("r", rank).where("r <= 3").groupBy(group).agg(F.max(score).alias("best"), F.round(F.avg(score), 6).alias("mean_top"))
    return top.withColumn("total", F.round(F.col("best") + 0.2 * F.col("mean_top"), 6))


def scheduled(items: DataFrame, positions: DataFrame, key: str, at: str, opens: int, closes: int) -> DataFrame:
    """key, at, origin: for each position, the items of its key that were planted `opens` to `closes` positions before it."""
    due = items.select(key, F.col(at).alias("origin"), F.explode(F.sequence(F.col(at) + opens, F.col(at) + closes)).alias(at)).distinct()
    return positions.select(key, at).distinct().join(due, [key, at])


def anonymised(rows: DataFrame, keys: list[str], text: str, author: str, names: dict[str, str]) -> DataFrame:
    """keys, body (names replaced in the listed order), digest of the body, reviewer (the first 8 digits of the author's digest)."""
    body = F.coalesce(text, F.lit(""))
    for name, cover in names.items():
        body = F.replace(body, F.lit(name), F.lit(cover))
    return rows.select(*keys, body.alias("body"), F.sha2(body, 256).alias("digest"), F.substring(F.sha2(author, 256), 1, 8).alias("reviewer"))


def resolved_ids(cited: DataFrame, seen: DataFrame, query: str, ids: str, id_col: str, most: int) -> DataFrame:
    """query, n_cited, n_grounded, n_rejected: of the first `most` cited ids those that the query's seen rows have."""
    each = cited.select(query, F.explode(F.slice(ids, 1, most)).alias(id_col))
    known = seen.select(query, id_col, F.lit(1).alias("known")).distinct()
    out = each.join(known, [query, id_col], "left").groupBy(query).agg(F.count("*").alias("n_cited"), F.count("known").alias("n_grounded"))
    return out.withColumn("n_rejected", F.col("n_cited") - F.col("n_grounded"))


def safe_texts(rows: DataFrame, id_col: str, body: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    """id, reason (of the first rule that rejects the row, else null), body (null where rejected)."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules])
    return rows.select(id_col, reason.alias("reason"), F.when(reason.isNull(), body).alias("body"))
