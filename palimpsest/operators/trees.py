"""Trees of clusters over vectors, layer upon layer, and one search over the nodes of all layers.

A layer is made by clustering the nodes of the one below. Trees of more than `cell_rows` nodes are first cut into cells of alike vectors, for all
trees at once, by rounds of joins and grouped means; a cell is then clustered in one task, so no task holds more than `cell_rows` vectors, and no
centres are held by the driver. Starting centres are picked by hashes of ids and a seed: the partitioning changes nothing but rounding.

Vectors are taken as `search.vectors` makes them (null, empty and non-finite ones are left out there). Leaf ids are unique and lie between 0 and 2 ** 48 - 1.
Equal vectors are dealt by id, so a cluster never has more than `most` children. An empty table gives no nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import nearest
from .tables import written

#: Bits of a leaf id; a cluster's id is its layer above them and its least leaf in them.
LEAF_BITS = 48


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _scattered(ids: np.ndarray, seed: int) -> np.ndarray:
    """The places of the ids in a fixed disorder."""
    h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.lexsort((ids, h * np.uint64(0xBF58476D1CE4E5B9)))


def clustered(ids: np.ndarray, vecs: np.ndarray, most: int, rounds: int, seed: int) -> np.ndarray:
    """A cluster's number for each vector: spherical k-means from scattered rows, then clusters of more than `most` vectors cut, the nearest to the centre first."""
    k = -(-len(ids) // most)
    centres = vecs[_scattered(ids, seed)[:k]]
    for i in range(rounds + 1):
        score = np.round(vecs @ centres.T, 9)
        label = score.argmax(1)
        if i < rounds:
            sums = np.zeros_like(centres)
            np.add.at(sums, label, vecs)
            centres = np.where(np.bincount(label, minlength=k)[:, None] > 0, _unit(sums), centres)
    order = np.lexsort((ids, -score[np.arange(len(ids)), label], label))
    first = np.concatenate(([True], label[order][1:] != label[order][:-1]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return np.unique(np.column_stack((label, place // most)), axis=0, return_inverse=True)[1].ravel()


def _cells(rows: DataFrame, cell_rows: int, rounds: int, seed: int) -> DataFrame:
    """rows (id, vec, group, ...) with `cell`: a piece of a group that has at most `cell_rows` rows."""
    now = rows.withColumn("cell", F.concat(F.lit("="), F.coalesce("group", F.lit(""))))
    while True:
        sized = now.groupBy("cell").agg(F.count("*").alias("n"))
        large = written(sized.where(F.col("n") > cell_rows))
        if large.isEmpty():
            return now
        split = now.join(large, "cell")
        scattered = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
        parts = F.least(F.lit(32), F.ceil(2 * F.col("n") / cell_rows))
        # Of each partition the first rows alone are shuffled: the rank has a constant limit.
        centres = split.withColumn("at", scattered).where(F.col("at") <= 32).where(F.col("at") <= parts).select((-F.col("at")).cast("long").alias("id"), "vec", F.col("cell").alias("group"))
        own = split.select("id", "vec", F.col("cell").alias("group"))
        for i in range(rounds + 1):
            centres = written(centres)
            found = nearest(own, centres, 1, "same", 9).select(F.col("query").alias("id"), F.col("id").alias("centre"))
            if i < rounds:
                mean = vector_to_array(Summarizer.mean(array_to_vector("vec")))
                centres = own.join(found, "id").groupBy("group", "centre").agg(mean.alias("vec")).select(F.col("centre").alias("id"), "vec", "group")
        label = written(split.select("id", "cell", "n").join(found, "id"))
        sizes = label.groupBy("cell", "centre").agg(F.count("*").alias("m"))
        # Vectors that no centre parts are dealt by id.
        piece = F.when(F.col("m") > 0.9 * F.col("n"), F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("m") / cell_rows) + 1)).otherwise(0)
        moved = label.join(sizes, ["cell", "centre"]).select("id", F.concat_ws(".", "cell", F.col("centre").cast("string"), piece.cast("string")).alias("to"))
        now = written(now.join(moved, "id", "left").withColumn("cell", F.coalesce("to", "cell")).drop("to"))


def _joined(layer: int, most: int, rounds: int, seed: int):
    """A cell's nodes to their parents; the first of a parent's rows has the parent's vec."""

    def join(cell: pd.DataFrame) -> pd.DataFrame:
        ids, vecs = cell["id"].to_numpy(), np.stack(cell["vec"].to_numpy())
        cell = cell.assign(number=clustered(ids, vecs, most, rounds, seed), leaf=ids & ((1 << LEAF_BITS) - 1))
        out = cell.groupby("number").agg(parent=("leaf", "min"), children=("id", "size"), leaves=("n_leaves", "sum"))
        out["parent"] += layer << LEAF_BITS
        means = [_unit(vecs[(cell["number"] == i).to_numpy()].mean(0)).tolist() for i in out.index]
        met = cell[["group", "id", "number"]].merge(out, left_on="number", right_index=True)
        again = met.duplicated("number").to_numpy()
        met["mean"] = [None if a else means[i] for a, i in zip(again, met["number"], strict=True)]
        return met[["group", "id", "parent", "mean", "children", "leaves"]]

    return join


def cluster_tree(rows: DataFrame, most: int = 10, layers: int = 5, seed: int = 224, rounds: int = 4, cell_rows: int = 4096) -> DataFrame:
    """tree, layer, node, parent, vec, n_children, n_leaves: the leaves (layer 0, the node is the id) and the clusters above them.

    rows: id, vec, group as `search.vectors` makes them; each group is a tree. A cluster's vec is the normalised mean of its children's. A tree
    ends with its root, or after `layers` layers of clusters; nodes without parent are null there.
    """
    size = F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves")
    now = written(rows.select("group", "id", "vec", *size))
    done = None
    for layer in range(1, layers + 1):
        counts = now.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("nodes"))
        growing = now.join(counts.where("nodes > 1"), F.col("group").eqNullSafe(F.col("of")), "left_semi")
        if growing.isEmpty():
            break
        made = written(_cells(growing, cell_rows, rounds, seed).groupBy("cell").applyInPandas(_joined(layer, most, rounds, seed), "group string, id long, parent long, mean array<double>, children long, leaves long"))
        # The root of a tree that is complete has no row in `made`, and so no parent.
        below = now.join(made.select("id", "parent"), "id", "left").select("group", F.lit(layer - 1).alias("layer"), "id", "parent", "vec", "n_children", "n_leaves")
        done = below if done is None else done.union(below)
        now = made.where("mean is not null").select("group", F.col("parent").alias("id"), F.col("mean").alias("vec"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"))
    last = now.select("group", F.shiftright("id", LEAF_BITS).cast("int").alias("layer"), "id", F.lit(None).cast("long").alias("parent"), "vec", "n_children", "n_leaves")
    done = last if done is None else done.union(last)
    return written(done.select(F.col("group").alias("tree"), "layer", F.col("id").alias("node"), "parent", "vec", "n_children", "n_leaves"))


def node_texts(tree: DataFrame, texts: DataFrame, text: str, most_tokens: int = 100) -> DataFrame:
    """tree, layer, node, text: a leaf's own text; a cluster's: the first tokens of its children's texts in their order, `most_tokens` divided by the children's number of each.

    texts: id and the column named. Leaves without text have an empty one.
    """
    own = texts.select(F.col("id").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    now = tree.where("layer = 0").join(own, "node", "left").select("tree", "layer", "node", "parent", F.coalesce("text", F.lit("")).alias("text"))
    out, top = now, tree.agg(F.max("layer")).first()[0] or 0
    for layer in range(1, top + 1):
        members = now.where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("node", tokens(F.col("text")).alias("t")))).alias("m"))
        each = F.greatest(F.lit(1), F.floor(F.lit(most_tokens) / F.size("m"))).cast("int")
        joined = members.select(F.col("parent").alias("node"), F.array_join(F.flatten(F.transform("m", lambda x: F.slice(x["t"], F.lit(1), each))), " ").alias("text"))
        now = written(tree.where(F.col("layer") == layer).join(joined, "node").select("tree", "layer", "node", "parent", "text"))
        out = out.union(now)
    return out.select("tree", "layer", "node", "text")


def collapsed_search(queries: DataFrame, tree: DataFrame, sizes: DataFrame, k: int = 10, budget: int = 8192, rule: str = "any", places: int = 6) -> DataFrame:
    """query, node, layer, rank, score, used: of each query's k nearest nodes of all layers, leaves and clusters alike, those that come before the budget is passed.

    queries as `search.vectors` makes them; a query never finds the leaf of its own id. sizes: node, size (null: 0). used adds up from the nearest on. rule: any tree, or `same` (the query's group).
    """
    nodes = tree.select(F.col("node").alias("id"), "vec", F.col("tree").alias("group"))
    hits = nearest(queries, nodes, k, rule, places).withColumnRenamed("id", "node")
    hits = hits.join(sizes.select("node", "size"), "node", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    used = F.sum("size").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    packed = hits.withColumn("used", used).where(F.col("used") <= budget)
    return packed.select("query", "node", F.shiftright("node", LEAF_BITS).cast("int").alias("layer"), "rank", "score", "used")


def token_sizes(texts: DataFrame, text: Column) -> DataFrame:
    """node, size in tokens."""
    return texts.select("node", F.size(tokens(text)).alias("size"))
