"""Graphs of levels, their integrity, and retrieval over them against brute force on the given graph."""

import collections

import numpy as np
import pytest

from palimpsest.operators import levels as L
from palimpsest.operators import routed as R
from palimpsest.operators.tables import numbered, successors
from palimpsest.plans import levels as P
from tests.conftest import SF

WEIGHT = {"INCLUSION": 0.55, "MAINLINE": 0.65, "DEPENDENCY": 0.95}


def test_numbers_and_successors(spark):
    rows = spark.createDataFrame([(g, i * 7 % 50) for g in ("a", "b", None) for i in range(50)] + [("c", 1)], "g string, i int").repartition(5)
    got = [(r["number"], r["g"], r["i"]) for r in numbered(rows, ["g", "i"]).orderBy("number").collect()]
    assert [n for n, _, _ in got] == list(range(1, 152))
    assert [(g, i) for _, g, i in got] == [(g, i) for g in (None, "a", "b") for i in range(50)] + [("c", 1)]
    pairs = sorted((r["g"], r["from_i"], r["to_i"]) for r in successors(rows, "g", ["i"], "i").collect())
    assert pairs == [(g, i, i + 1) for g in "ab" for i in range(49)]
    assert numbered(rows.limit(0), ["g", "i"]).count() == 0


def violated(spark, nodes, edges):
    nodes = spark.createDataFrame(nodes, "node string, level int, time long, status string")
    edges = spark.createDataFrame(edges, "source string, target string, edge_type string, phase string")
    return sorted(tuple(r) for r in L.violations(nodes, edges).collect())


def test_integrity_rules(spark):
    nodes = [("r", 1, None, "Active"), ("v", 2, 1, "Pending"), ("s", 3, 2, "Done"), ("f", 4, 3, "Done"), ("g", 4, 3, None)]
    tree = [("r", "v", "INCLUSION", None), ("v", "s", "INCLUSION", None), ("s", "f", "INCLUSION", None), ("s", "g", "INCLUSION", None)]
    assert violated(spark, nodes, tree) == [("unknown_status", None, "g")]
    nodes[4] = ("g", 4, 3, "Done")
    assert violated(spark, nodes, [*tree, ("s", "s2", "MAINLINE", None), (None, "s", "OTHER", None)]) == [("missing_source", None, "s"), ("missing_target", "s", "s2"), ("unknown_type", None, "s")]
    assert violated(spark, nodes, [*tree, ("f", "g", "DEPENDENCY", "state_lifecycle"), ("f", "s", "DEPENDENCY", "pre_write"), ("r", "s", "DEPENDENCY", "x"), ("v", "f", "DEPENDENCY", "pre_write")]) == [
        ("from_future", "f", "s"), ("from_pending", "v", "f"), ("from_same_time", "f", "g"), ("from_top", "r", "s"), ("pre_write_level", "v", "f"), ("unknown_phase", "r", "s"),
    ]
    assert violated(spark, [*nodes, ("f", 4, 3, "Done"), ("o", 2, 1, "Done")], [*tree, ("r", "s", "INCLUSION", None)]) == [("inclusion_levels", "r", "s"), ("many_parents", None, "s"), ("no_parent", None, "o"), ("repeated_node", None, "f")]
    assert violated(spark, [], []) == []


@pytest.mark.parametrize("graph", [P._schema_graph, P._topic_graph])
def test_built_graphs_are_sound(spark, graph):
    _, nodes, edges = graph(spark, SF)
    rows = nodes.selectExpr("node", "level", "cast(null as long) as time", "'Active' as status")
    assert L.violations(rows, edges.selectExpr("source", "target", "edge_type", "'' as phase"), phases=False).collect() == []
    kinds = collections.Counter(r["edge_type"] for r in edges.collect())
    assert min(kinds[k] for k in L.EDGE_TYPES) > 20


def test_rows_with_unknown_parents_are_reported(spark):
    row = lambda *r: spark.createDataFrame(r, "key string, parent string, doc string, place int, date string")
    levels = [L.Level(2, "A", row(("a", None, None, 0, None), (None, None, None, 1, None)), "x"), L.Level(3, "B", row(("b", "a", "d", 1, None), ("c", "zz", "d", 0, None), ("e", None, "d", 2, None)), "y")]
    nodes, edges = L.level_graph(levels, [L.Chain("B", "doc", ["place"], "next")])
    assert sorted((r["source"], r["target"], r["edge_type"]) for r in edges.collect()) == [("?zz", "L3_B1", "INCLUSION"), ("L1_Corpus0", "L2_A1", "INCLUSION"), ("L1_Corpus0", "L3_B3", "INCLUSION"), ("L2_A1", "L3_B2", "INCLUSION"), ("L3_B1", "L3_B2", "MAINLINE"), ("L3_B2", "L3_B3", "MAINLINE")]
    bad = L.violations(nodes.selectExpr("node", "level", "place as time", "'Active' as status"), edges.selectExpr("*", "'' as phase"))
    assert sorted((r["rule"], r["target"]) for r in bad.collect()) == [("inclusion_levels", "L3_B3"), ("missing_source", "L3_B1")]


def brute(queries, walk, edges, above, rule, k):
    """The walk of each query by plain loops over all nodes and paths."""
    by = {r["id"]: r for r in walk}
    near, leaves, out = collections.defaultdict(list), collections.defaultdict(set), {}
    for e in edges:
        for a, b in ((e["source"], e["target"]), (e["target"], e["source"])):
            near[a].append((b, e["edge_type"], e["relation"], WEIGHT[e["edge_type"]] * max(0.45, e["strength"])))
    for r in above:
        leaves[r["node"]].add(r["leaf"])
    gate = {"event_temporal_next": "temporal", "same_attribute": "comparison"}

    def bonus(op, types, relations):
        if rule is R.EDGES:
            return 0.015 if op == "temporal" and types[-1] == "MAINLINE" else 0.015 if op == "comparison" and "crossdoc" in relations[-1] else 0.01 if op == "inference" and types[-1] == "DEPENDENCY" else 0.0
        told = {"same_entity_event", "same_attribute", "event_temporal_next", "narrative_dependency"} & set(relations)
        kind = {"temporal": {"event_temporal_next"}, "comparison": {"same_attribute"}, "inference": {"same_entity_event", "narrative_dependency"}}[op]
        return (0.005 if told else 0.0) + 0.02 * len(kind & set(relations))

    for q in queries:
        op, score = q["operator"], {n: round(float(np.dot(q["vec"], r["vec"])), 6) + 0.0 for n, r in by.items() if n != q["id"]}
        top = lambda level, n: sorted((x for x in score if by[x]["level"] == level), key=lambda x: (-score[x], x))[:n]  # noqa: E731, B023
        direct = top(4, rule.direct)
        seeds = {s for level, n in rule.seeds.items() for s in top(level, n)}
        cutoff, best = score[direct[-1]] - rule.cutoff, {}
        for seed in seeds:
            frontier = [([seed], [], [], 1.0)]
            for _ in range(rule.hops):
                grown = []
                for path, types, relations, weight in frontier:
                    for target, kind, relation, step in near[path[-1]]:
                        allowed = relation == "chunk_crossdoc" and op == "inference" if rule is R.EDGES else gate.get(relation, op) == op
                        if target in path or target not in by or not allowed:
                            continue
                        grown.append(([*path, target], [*types, kind], [*relations, relation], weight * step))
                        gain = rule.of_seed * max(0.0, score[seed]) + rule.of_weight * weight * step + bonus(op, [*types, kind], [*relations, relation]) + rule.of_target * max(0.0, score[target])
                        for leaf in sorted(leaves[target], key=lambda x: (-score[x], x))[: rule.leaves]:
                            if leaf not in direct and score[leaf] >= cutoff:
                                best[leaf] = max(best.get(leaf, -9), score[leaf] + gain)
                frontier = grown
        rows = sorted([(-score[n], n, "direct") for n in direct] + [(-round(s, 9), n, "edge_routed") for n, s in best.items()])
        kept, texts, docs = [], set(), collections.Counter()
        for s, n, origin in rows:
            text = " ".join((by[n]["text"] or "").split())
            if text not in texts and docs[by[n]["doc"]] < rule.per_doc and len(kept) < k:
                kept.append((n, origin, -s))
                texts.add(text)
                docs[by[n]["doc"]] += 1
        out[q["id"]] = kept
    return out


@pytest.mark.parametrize(("search", "rule"), [(P.schema_search, R.SCHEMA), (P.topic_search, R.EDGES)])
def test_retrieval_against_brute_force(spark, search, rule):
    queries, walk, edges, above = search(spark, SF)
    queries, walk, edges, above = (x.cache() for x in (queries, walk, edges, above))
    got = collections.defaultdict(list)
    for r in R.retrieved(queries, walk, edges, above, rule).orderBy("query", "place").collect():
        assert r["path"][0] == r["seed"] and len(r["relations"]) == len(r["path"]) - 1
        got[r["query"]].append((r["node"], r["origin"], r["score"]))
    want = brute(queries.collect(), walk.collect(), edges.collect(), above.collect(), rule, 10)
    assert any(o == "edge_routed" for rows in want.values() for _, o, _ in rows)
    for q, rows in want.items():
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in rows], abs=3e-6)
        assert {x[:2] for x in got[q][:-1]} <= {x[:2] for x in rows} | {x[:2] for x in got[q] if abs(x[2] - rows[-1][2]) < 3e-6}


def test_hierarchy_rows(spark):
    queries, walk, edges, above = P.schema_search(spark, SF)
    rows = P.g10_schema_contexts(spark, SF).collect()
    by_query = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query"], r["section"], r["place"])):
        by_query[r["query"]].append((r["section"], r["place"], r["name"]))
    schema = {r["leaf"]: r["node"] for r in above.collect() if r["node"] in {x["id"] for x in walk.where("level = 2").collect()}}
    name = {r["id"]: r["node"] for r in walk.collect()}
    place = {r["node"]: r["place"] for r in walk.collect()}
    of = {name[a]: name[b] for a, b in schema.items()}
    for found in by_query.values():
        assert [x[0] for x in found] == sorted(x[0] for x in found) and [x[2][:2] for x in found if x[0] < 2] == ["L1"] + ["L2"] * sum(x[0] == 1 for x in found)
        order = [x[2] for x in found if x[0] == 1]
        evidence = [x[2] for x in found if x[0] == 2]
        assert set(order) == {of[e] for e in evidence}
        assert evidence == sorted(evidence, key=lambda e: (order.index(of[e]), place[e], evidence.index(e)))
