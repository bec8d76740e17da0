"""Sinks and sources of graphs, vector indexes, numbered texts and nested evaluator files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import digest

_NODE = "struct<node_id:string,level:string,content:string>"
_EDGE = "struct<source:string,target:string,edge_type:string>"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (graph, node_id, level, content) and edges (graph, source, target, edge_type) as two Parquet tables below the path."""
    nodes.select("graph", "node_id", "level", "content").write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.select("graph", "source", "target", "edge_type").write.mode("errorifexists").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, body: one JSON document a graph, with its nodes and edges in order. A graph is one row: for graphs that fit a task."""
    n = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("node_id", "level", "content"))).alias("nodes"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type"))).alias("edges"))
    none = F.array().cast(f"array<{_EDGE}>")
    return n.join(e, "graph", "left").select("graph", F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("body"))


def graph_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and for each (graph, level) the next running id: one above the largest trailing number of its node ids."""
    parsed = documents.select("graph", F.from_json("body", f"struct<nodes:array<{_NODE}>,edges:array<{_EDGE}>>").alias("g"))
    nodes, edges = (parsed.select("graph", F.inline(f"g.{part}")) for part in ("nodes", "edges"))
    number = F.regexp_extract("node_id", r"(\d+)$", 1).try_cast("long")
    return nodes, edges, nodes.groupBy("graph", "level").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))


def write_vectors(rows: DataFrame, path: str, index: str) -> DataFrame:
    """Writes (unit_id, vec) as float32 and a descriptor beside them: index, n, dimension and a digest of what was written."""
    rows.select(F.col("unit_id").cast("long"), F.col("vec").cast("array<float>")).write.mode("errorifexists").parquet(f"{path}/vectors")
    described = described_vectors(rows.sparkSession.read.parquet(f"{path}/vectors")).withColumn("index", F.lit(index))
    described.write.mode("errorifexists").parquet(f"{path}/descriptor")
    return rows.sparkSession.read.parquet(f"{path}/descriptor")


def described_vectors(vectors: DataFrame) -> DataFrame:
    """n, dimension (null if lengths differ), content_sha256."""
    one = vectors.agg(F.when(F.min(F.size("vec")) == F.max(F.size("vec")), F.min(F.size("vec"))).alias("dimension"))
    return digest(vectors).withColumnRenamed("n_rows", "n").crossJoin(one)  # one row on each side


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and one row with `intact`: whether number, dimension and digest are the descriptor's."""
    vectors, stored = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/descriptor")
    now = described_vectors(vectors).select(F.col("n").alias("n2"), F.col("dimension").alias("d2"), F.col("content_sha256").alias("h2"))
    same = (F.col("n") == F.col("n2")) & F.col("dimension").eqNullSafe(F.col("d2")) & (F.col("content_sha256") == F.col("h2"))
    return vectors, stored.crossJoin(now).select("index", "n", "dimension", same.alias("intact"))  # one row on each side


def numbered_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """number (the first in the file's name), text; and one row with n, least, most, complete: whether the numbers are 1 to n, each once.

    Spark reads no rows from empty files: they are missing numbers.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)", 1).try_cast("long")
    texts = reader.format("binaryFile").load(path).select(name.alias("number"), F.col("content").cast("string").alias("text"))
    check = texts.agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("most"), F.count_distinct("number").alias("d"))
    complete = (F.col("least") == 1) & (F.col("most") == F.col("n")) & (F.col("d") == F.col("n"))
    return texts, check.select("n", "least", "most", F.coalesce(complete, F.lit(False)).alias("complete"))


def solved_labels(rows: DataFrame, body: str) -> DataFrame:
    """query, round, label of JSON texts {query: {is_solved: {round: label}}}; texts that are no such JSON give no rows."""
    kind = "map<string,struct<is_solved:map<string,string>>>"
    each = rows.select(F.explode(F.from_json(body, kind)).alias("query", "v"))
    return each.select("query", F.explode("v.is_solved").alias("round", "label"))


def by_position(ids: DataFrame, values: DataFrame, place: str) -> DataFrame:
    """Rows of two tables that share a place written with them; values without id and ids without value are kept with nulls."""
    return ids.join(values, place, "full_outer")
