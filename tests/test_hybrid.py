"""Rules that SQL can't express, and odd rows, of the hybrid operators."""

import random

from palimpsest.operators import hybrid as H
from palimpsest.operators.components import capped_components


def _greedy(edges, most):
    home = {n: n for a, b, _ in edges for n in (a, b)}
    for a, b, s in sorted((e for e in edges if e[0] != e[1]), key=lambda e: (-e[2], e[0], e[1])):
        x, y = home[a], home[b]
        if x != y and sum(c in (x, y) for c in home.values()) <= most:
            home = {n: min(x, y) if c in (x, y) else c for n, c in home.items()}
    return {n: (c, sum(d == c for d in home.values())) for n, c in home.items()}


def test_capped_components(spark):
    rnd = random.Random(5)
    edges = list({(a, b): (a, b, rnd.randint(0, 8) / 8) for a, b in ((rnd.randrange(24), rnd.randrange(24)) for _ in range(60)) if a < b}.values())
    for most in (1, 5):
        got = capped_components(spark.createDataFrame([*edges, (None, 3, 0.5), (3, 4, None)], "a long, b long, score double"), most).collect()
        assert {r["node"]: (r["component"], r["size"]) for r in got} == _greedy(edges, most)
    assert capped_components(spark.createDataFrame([], "a long, b long, score double"), 3).count() == 0


def test_names_are_replaced_at_once_and_literally(spark):
    table = lambda rows: spark.createDataFrame(rows, "q long, position long, schema string, name string")
    reference = table([(1, 0, "s", "b"), (1, 1, "s", "c"), (1, 2, "s", "x\\E"), (2, 0, "s", "n"), (3, 0, "s", "n"), (3, 1, "s", "m"), (4, 0, None, "n")])
    candidate = table([(1, 0, "s", "a"), (1, 1, "s", "b"), (1, 2, "s", "a.+\\Eb"), (2, 0, "t", "o"), (3, 0, "s", "o"), (3, 1, "s", "o"), (4, 0, None, "n"), (5, 0, "s", "z")])
    texts = spark.createDataFrame([(1, 1, "a b a.+\\Eb ab"), (1, 2, None), (1, 3, ""), (2, 1, "o"), (3, 1, "o"), (4, 1, "n"), (5, 1, "z"), (6, 1, "y")], "q long, id long, text string")
    got = {(r["q"], r["id"]): (r["text"], r["n_names"], r["verdict"]) for r in H.renamed_by_position(reference, candidate, texts, "q").collect()}
    assert got[1, 1] == ("b c x\\E bc", 3, "renamed") and got[1, 2][0] == got[1, 3][0] == ""
    assert {k[0]: v for k, v in got.items() if k[0] > 1} == {2: ("o", 0, "schema"), 3: ("o", 0, "ambiguous"), 4: ("n", 0, "equal"), 5: ("z", 0, "count"), 6: ("y", 0, "equal")}


def test_dependency_recall_bases(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "free text", "b"), (3, "a", "b")], "item long, source string, target string")
    nodes = spark.createDataFrame([(1, "a", "The Red  fox"), (1, "b", "a den"), (2, "a", "red fox"), (3, "a", None)], "item long, node string, text string")
    gold = spark.createDataFrame([(1, 0, "red fox", "den"), (1, 1, "FREE", None), (1, 2, "", "den"), (1, 3, "den", "red"), (2, 0, "red", "")], "item long, n long, source string, target string")
    got = {r["item"]: (r["n_gold"], r["n_hit"], r["recall"], r["basis"]) for r in H.dependency_recall(items, edges, nodes, gold, "item").collect()}
    assert got == {1: (4, 2, 0.5, "literal"), 2: (1, 0, 0.0, "empty"), 3: (0, 0, 1.0, "no_gold")}


def test_rendered_cuts_the_crossing_line(spark):
    nodes = spark.createDataFrame([(1, "a", 1, "x" * 50), (1, "b", 2, "y" * 300), (1, "c", 3, "z"), (2, "a", 1, "w" * 195)], "t long, node string, place long, line string")
    edges = spark.createDataFrame([(1, "a", "b", "K"), (1, "a", "q", "K"), (2, "a", "a", "K")], "t long, source string, end string, kind string")
    got = {r["t"]: (r["text"], r["n_nodes"], r["n_edges"]) for r in H.rendered(nodes, edges, "t", "H\n", 200).collect()}
    assert got[1] == (("H\n" + "x" * 50 + "y" * 144 + "...\nRelations:\n- a -K-> b\n")[:200], 2, 1)
    assert got[2] == ("H\n" + "w" * 195, 1, 0)


def test_empty_tables(spark):
    pairs = spark.createDataFrame([], "t long, source long, semantic double, task double, gap long, same_key boolean")
    assert H.union_ranked({"Vc": pairs, "Vr": pairs}, pairs, ["t"], 3).count() == 0
    wanted = spark.createDataFrame([(1, 0, "scope", "a b"), (1, 1, "anchor", None), (2, 0, "scope", "c")], "q long, n int, kind string, item string")
    texts = spark.createDataFrame([(1, 7, "A  B c"), (1, 8, None), (2, 7, "a b")], "q long, node long, text string")
    ledger = H.coverage(wanted, texts, "q")
    assert sorted((r["q"], r["n"], r["hits"]) for r in ledger.collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 0)]
    needed = spark.createDataFrame([(1, True), (2, False), (3, True)], "q long, needed boolean")
    assert sorted((r["q"], r["scope_complete"], r["status"]) for r in H.coverage_status(ledger, needed, "q").collect()) == [(1, True, "partial"), (2, False, "not_required"), (3, False, "partial")]
