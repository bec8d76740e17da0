"""Every registered query with SQL gives the SQL's rows."""

import pytest

from palimpsest.plans import catalogue, registry
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(same, name):
    same(registry.QUERIES[name], registry.SQL[name])


#: These are held against brute force in test_operators.py, test_rewrites.py , test_trees.py, test_levels.py and test_resumption.py.
WITHOUT_SQL = {"a7_wide_matrix", "e18_capped_edges", "e9_topic_edges", "g9_edge_routed", "g10_schema_contexts", "g10_schema_retrieval", "g11_cluster_tree", "g11_collapsed_tree", "e19_capped_components", "g22_hashed_bigrams", "k1_best_of_answers", "k5_order_accuracy", "l7_reliability", "o3_vector_contexts"}


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) | WITHOUT_SQL


def test_newest_item_beyond_the_budget_is_cut_not_dropped(spark):
    long = " ".join(f"t{i}" for i in range(9))
    rows = [(1, 1, "a b"), (1, 2, long), (1, 3, ""), (1, 4, "x y"), (1, 5, "z"), (1, 6, "last")]
    got = registry.D.newest_as_of(spark.createDataFrame(rows, "conv_id long, turn long, text string"), "conv_id", "turn", "text", 4).collect()
    assert sorted((r["as_of"], r["turn"], r["n_tokens"], r["cut"], r["used"], r["body"]) for r in got) == [(3, 1, 2, False, 2, "a b"), (4, 2, 4, True, 4, "t5 t6 t7 t8"), (5, 2, 4, True, 4, "t5 t6 t7 t8"), (6, 4, 2, False, 2, "x y")]


def test_every_document_is_counted_and_has_a_verdict(spark):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sum(r["n"] for r in registry.QUERIES["a7_source_counts"](spark, SF).collect()) == len(ids)
    assert sorted(r["doc_id"] for r in registry.QUERIES["n7_every_document"](spark, SF).collect()) == ids
