"""Evidence lines of long items, entity graphs for local search, and answering methods as plug-ins.

Null texts are empty; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms, words
from .folds import skip_pack

#: What a term gives by its line frequency, what the phrase and what a role's mention add.
TERM, PHRASE, ROLE = 12.0, 100.0, 3.0


def evidence_lines(items: DataFrame, id_col: str, budget: int, beside: int = 1) -> DataFrame:
    """id, line, score, used: the lines (from 0) of an item that tell most about what is asked, within `budget` characters.

    items: id, text, asked (array of lower-cased words), phrase, role; ids are unique. A line scores 12 / (lines of the item that have it)
    for each asked word it has, 100 for the phrase as whole words, 3 for the role's name; 6 places. Lines within `beside` places of a scored
    one come after all scored ones, with score 0. A line that does not fit is left out and the next is tried.
    """
    key = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    held = lambda c: F.coalesce((F.col(c) != "") & F.contains(key, F.concat(F.lit(" "), F.col(c), F.lit(" "))), F.lit(False))
    each = items.where(F.col(id_col).isNotNull()).select(id_col, "asked", "phrase", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "body"))
    each = each.withColumn("w", words(F.col("body")))
    more = F.when(held("phrase"), PHRASE).otherwise(0.0) + F.when(held("role"), ROLE).otherwise(0.0)
    flat = each.select(id_col, "line", F.length("body").alias("size"), more.alias("more"))
    hits = each.select(id_col, "line", F.explode(F.array_intersect(F.col("w"), F.col("asked"))).alias("term"))
    frequency = hits.groupBy(id_col, "term").agg(F.count("*").alias("df"))
    told = hits.join(frequency, [id_col, "term"]).groupBy(id_col, "line").agg(F.sum(TERM / F.col("df")).alias("told"))
    scored = flat.join(told, [id_col, "line"], "left").withColumn("score", F.round(F.coalesce("told", F.lit(0.0)) + F.col("more"), 6))
    near = Window.partitionBy(id_col).orderBy("line").rangeBetween(-beside, beside)
    scored = scored.withColumn("around", F.max("score").over(near)).where("around > 0").select(id_col, "line", "score", "size")
    kept = skip_pack(scored, id_col, [-F.col("score"), F.col("line")], "line", F.col("size"), budget)
    return kept.join(scored.drop("size"), [id_col, "line"]).select(id_col, "line", "score", "used")


def local_graph(entities: DataFrame, nodes: DataFrame, reports: DataFrame, units: DataFrame, relationships: DataFrame, level: int) -> DataFrame:
    """id, title, community, level, report_rank, n_units, degree, weight of every entity that has a node at `level` or above it.

    entities: id, title; nodes: id, community, level; reports: community, rank; units: unit, id; relationships: source, target, weight.
    An entity's community is its deepest one within the level (ties: the smaller name); relationships count where both ends are such entities.
    """
    inside = nodes.where(F.col("level") <= level).groupBy("id").agg(F.min(F.struct((-F.col("level")).alias("l"), "community")).alias("n"))
    known = entities.join(inside, "id").select("id", "title", "n.community", (-F.col("n.l")).alias("level"))
    ids = known.select("id")
    edges = relationships.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    ends = edges.select(F.col("source").alias("id"), "weight").unionAll(edges.where("source <> target").select("target", "weight"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 6).alias("weight"))
    n_units = units.groupBy("id").agg(F.countDistinct("unit").alias("n_units"))
    ranked = reports.groupBy("community").agg(F.max("rank").alias("report_rank"))
    out = known.join(ranked, "community", "left").join(n_units, "id", "left").join(degree, "id", "left")
    return out.select("id", "title", "community", "level", "report_rank", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_units", "degree")], F.coalesce("weight", F.lit(0.0)).alias("weight"))


def embedded(rows: DataFrame, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """The rows with `vec`: embed is any function from a text column to an array column, built in or a pandas UDF."""
    return rows.withColumn("vec", embed(F.coalesce(text, F.lit(""))))


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def method(name: str):
    """Registers an answering method: from (query, question, id, text) to (query, answer, evidence)."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in METHODS:
            raise ValueError(f"there is a method {name} already")
        METHODS[name] = f
        return f

    return register


def answered(context: DataFrame, name: str) -> DataFrame:
    """query, method, answer, evidence of every query in the context (query, question, id, text), by the method of that name."""
    return METHODS[name](context).select("query", F.lit(name).alias("method"), "answer", "evidence")


@method("keyword")
def keyword(context: DataFrame) -> DataFrame:
    """The text that shares most terms with the question, the latest id of several; without any shared term the latest text."""
    shared = F.size(F.array_intersect(terms(F.col("question")), terms(F.col("text"))))
    best = context.groupBy("query").agg(F.max(F.struct(shared.alias("n"), "id", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    return best.select("query", F.col("x.text").alias("answer"), F.col("x.id").alias("evidence"))
