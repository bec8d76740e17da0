"""Queries over trees of clusters. Clustering can't be stated in SQL: tests hold tree and search against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import trees as T
from ..sources.records import table
from .registry import _DOCS, _plain


def _tree(spark, sf_dir):
    return S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), T.cluster_tree(S.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@_plain
def g11_cluster_tree(spark, sf_dir):
    """One tree over all vectors."""
    return _tree(spark, sf_dir)[1].select("layer", "node", "parent", "n_children", "n_leaves")


@_plain
def g11_collapsed_tree(spark, sf_dir):
    """Every 50th vector asks all layers; the document of a vector's id is its text."""
    rows, tree = _tree(spark, sf_dir)
    texts = T.node_texts(tree, _DOCS(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "text")
    return T.collapsed_search(rows.where("id % 50 = 0"), tree, T.token_sizes(texts, F.col("text")), 10, 2000)
