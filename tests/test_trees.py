"""Cluster trees: their invariants, and the search over all layers against brute force on the given tree."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search as S
from palimpsest.operators import trees as T
from palimpsest.plans import catalogue
from tests.conftest import SF


def invariants(nodes, leaves, most):
    by = {r["node"]: r for r in nodes}
    assert len(by) == len(nodes)
    assert {r["node"] for r in nodes if r["layer"] == 0} == set(leaves)
    children = collections.defaultdict(list)
    for r in nodes:
        if r["parent"] is not None:
            assert by[r["parent"]]["layer"] == r["layer"] + 1 and by[r["parent"]]["tree"] == r["tree"]
            children[r["parent"]].append(r)
    for r in nodes:
        if r["layer"]:
            own = children[r["node"]]
            assert 1 <= len(own) <= most and r["n_children"] == len(own) and r["n_leaves"] == sum(c["n_leaves"] for c in own)
            mean = np.mean([c["vec"] for c in own], 0)
            assert np.allclose(r["vec"], mean / max(np.linalg.norm(mean), 1e-300), atol=1e-9)
        else:
            assert (r["n_children"], r["n_leaves"]) == (0, 1)
    roots = collections.Counter(r["tree"] for r in nodes if r["parent"] is None)
    assert set(roots.values()) <= {1}
    return by


def vectors(spark, rows):
    return S.vectors(spark.createDataFrame(rows, "id long, v array<double>, tree string"), "id", "v", "tree")


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_tree_over_odd_rows(spark, cell_rows):
    """Several trees, equal vectors, zero vectors and unusable rows; small cells take the distributed way."""
    rng = np.random.default_rng(cell_rows)
    rows = [(i, rng.normal(size=4).tolist(), "a") for i in range(90)] + [(100 + i, [1.0, 2.0, 0.0, 0.0], "b") for i in range(47)]
    rows += [(200, [0.0] * 4, "c"), (201, [0.0] * 4, "c"), (300, [1.0, 0.0, 0.0, 0.0], "d"), (400, None, "a"), (401, [float("nan")] * 4, "a"), (402, [], "a"), (403, [1.0, 1.0, 1.0, 1.0], None), (404, [1.0, 1.0, 0.0, 1.0], None)]
    tree = T.cluster_tree(vectors(spark, rows), 5, cell_rows=cell_rows, rounds=2)
    nodes = tree.collect()
    invariants(nodes, [r[0] for r in rows if r[0] not in (400, 401, 402)], 5)
    assert max(r["layer"] for r in nodes if r["tree"] == "a") >= 3
    assert [r["layer"] for r in nodes if r["tree"] == "d"] == [0]
    assert T.cluster_tree(vectors(spark, rows).limit(0)).count() == 0


def test_alike_vectors_share_clusters(spark):
    rng = np.random.default_rng(1)
    base = np.eye(8)
    rows = [(i, (base[i % 8] + rng.normal(size=8) / 50).tolist(), None) for i in range(64)]
    parents = {r["node"]: r["parent"] for r in T.cluster_tree(vectors(spark, rows), 8, rounds=8).where("layer = 0").collect()}
    pure = [len({c % 8 for c, p in parents.items() if p == q}) == 1 for q in set(parents.values())]
    assert np.mean(pure) > 0.6


def test_collapsed_search_against_brute_force(spark):
    vectors_, tree = S.vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding"), None
    tree = T.cluster_tree(vectors_)
    nodes = tree.collect()
    by = invariants(nodes, [r["id"] for r in vectors_.select("id").collect()], 10)
    assert max(r["layer"] for r in nodes) >= 2
    sizes = {n: 7 + n % 13 for n in by}
    sized = tree.select("node", (7 + F.col("node") % 13).alias("size"))
    got = collections.defaultdict(list)
    for r in T.collapsed_search(vectors_.where("id % 50 = 0"), tree, sized, 10, 90).orderBy("query", "rank").collect():
        got[r["query"]].append((r["node"], r["layer"], r["score"], r["used"]))
    for q in [n for n in by if by[n]["layer"] == 0 and n % 50 == 0]:
        scores = sorted((-round(float(np.dot(by[q]["vec"], r["vec"])), 6), n) for n, r in by.items() if n != q)[:10]
        want, used = [], 0
        for s, n in scores:
            used += sizes[n]
            if used > 90:
                break
            want.append((n, by[n]["layer"], -s, used))
        assert [x[:2] + x[3:] for x in got[q]] == [x[:2] + x[3:] for x in want]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_texts_of_clusters(spark):
    tree = spark.createDataFrame([("t", 0, 1, 9 << 48), ("t", 0, 2, 9 << 48), ("t", 0, 3, 9 << 48)], "tree string, layer int, node long, parent long").union(spark.createDataFrame([("t", 1, 9 << 48, None)], "tree string, layer int, node long, parent long"))
    texts = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "x, y")], "id long, text string")
    got = {r["node"]: r["text"] for r in T.node_texts(tree, texts, "text", 7).collect()}
    assert got == {1: "a b c d", 2: "", 3: "x, y", 9 << 48: "a b x ,"}


def test_tree_query_packs_whole_tables(spark):
    rows = catalogue.QUERIES["g11_collapsed_tree"](spark, SF).collect()
    assert {r["query"] for r in rows} == set(range(0, 500, 50)) and any(r["layer"] > 0 for r in rows) and all(r["used"] <= 2000 for r in rows)
