"""Operators against brute force and on odd rows: nulls, empty texts and tables, ties, repeated rows, long lists."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import adapters, answers, folds, graphs, relations, retrieval, scoring, search, selection, walks
from palimpsest.plans import catalogue
from palimpsest.sources import artifacts, records

from .conftest import SF


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def lcs(a, b):
    if not a or not b:
        return 0
    return lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(lcs(a[:-1], b), lcs(a, b[:-1]))


def test_common_subsequence_against_recursion():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 3, rng.integers(0, 8)).tolist() for _ in range(2))
        assert answers.common_subsequence(a, b) == lcs(a, b)


def test_best_of_answers_against_brute_force(spark):
    texts = [("a b c d", ["b d", "a b x"]), ("same text", ["Same  text"]), ("x", []), (None, ["a"]), ("", [""]), ("a a b", ["a b b", None]), ("p q", None)]
    rows = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(texts)], "id long, text string, answers array<string>")
    want = []
    for i, (text, given) in enumerate(texts):
        best = [0, 0.0, 0.0, 0]
        for g in given or []:
            if g is None:
                continue
            p, q = (text or "").lower().split(), g.lower().split()
            same = sum((collections.Counter(p) & collections.Counter(q)).values())
            f = lambda x: round(1.0 if not p and not q else 2 * x / (len(p) + len(q)), 9)  # noqa: B023, E731
            best = [max(best[0], int(p == q)), max(best[1], f(same)), max(best[2], f(lcs(p, q))), max(best[3], int(bool(q) and " ".join(q) in " ".join(p)))]
        want.append((i, *best))
    assert rows_of(answers.best_of_answers(rows, "id", "text", "answers"), "id", "exact", "f1", "rouge_l", "in_text") == want
    assert answers.best_of_answers(rows.limit(0), "id", "text", "answers").count() == 0


def test_answer_queries_without_sql(spark):
    assert catalogue.QUERIES["k1_best_of_answers"](spark, SF).where("rouge_l between 0 and 1 and f1 >= rouge_l - 1e-9").count() == records.table(spark, SF, "conversations").count()
    events = collections.defaultdict(list)
    for r in records.table(spark, SF, "events").orderBy("event_id").collect():
        events[r["user_id"]].append(r["event_type"])
    want = {u: answers.common_subsequence(e[:12], e[12:24]) for u, e in events.items()}
    assert {r["user_id"]: r["lcs"] for r in catalogue.QUERIES["k5_order_accuracy"](spark, SF).collect()} == want


def test_hashed_bigrams_against_zlib(spark):
    texts = ["", None, "a", "ab", "héllo wörld", "aaaa", "日本語です"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in rows.select("id", search.hashed_bigrams(F.col("text")).alias("v")).collect():
        want = [0.0] * 128
        for i in range(len(texts[r["id"]] or "") - 1):
            want[zlib.crc32(texts[r["id"]][i : i + 2].encode()) % 128] += 1
        assert r["v"] == want
    assert catalogue.QUERIES["g22_hashed_bigrams"](spark, SF).where("size(buckets) <> 128").count() == 0


def test_greedy_groups_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, int(rng.integers(0, 40))) for g in range(6) for i in range(int(rng.integers(1, 25)))] + [(99, 0, None)]
    target, most, tail, n_most = 50, 70, 25, 4
    got = folds.greedy_groups(spark.createDataFrame(rows, "g long, i long, v long"), "g", "i", F.col("v"), target, most, tail, n_most)
    want = []
    for g in {r[0] for r in rows}:
        unit, used, n, made = 0, 0, 0, []
        for _, i, v in sorted(r for r in rows if r[0] == g):
            v = v or 0
            if n and (used >= target or used + v > most or n >= n_most):
                unit, used, n = unit + 1, 0, 0
            used, n = used + v, n + 1
            made.append([g, i, unit, v])
        last = made[-1][2]
        if last and sum(m[3] for m in made if m[2] == last) < tail:
            made = [[a, b, min(u, last - 1), v] for a, b, u, v in made]
        want += [tuple(m) for m in made]
    assert rows_of(got, "g", "i", "unit", "size") == sorted(want, key=repr)


def test_skip_pack_and_diversified_on_odd_rows(spark):
    items = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, None), (2, 1, 500)], "g long, i long, v long")
    assert rows_of(folds.skip_pack(items, "g", [F.col("i")], "i", F.col("v"), 100), "g", "i", "used") == [(1, 1, 60), (1, 3, 100), (1, 4, 100)]
    assert folds.skip_pack(items.limit(0), "g", [F.col("i")], "i", F.col("v"), 100).count() == 0
    hits = [(1, 1, "a", "s", "x"), (1, 2, "b", "s", "x"), (1, 3, "c", "s", "y"), (1, 4, "d", "s", "z"), (1, 5, "e", "t", "z"), (1, 6, "f", None, None), (1, 7, "g", None, "")]
    got = folds.diversified(spark.createDataFrame(hits, "q long, r long, doc string, src string, text string"), "q", "r", "doc", "src", F.col("text"), 2, 10)
    # d is rejected by the cap, so its text does not block e; g repeats f's empty text
    assert rows_of(got, "doc", "place") == [("a", 1), ("c", 2), ("e", 3), ("f", 4)]


def test_collapsed_blocks(spark):
    blocks = [(1, 1, "the quick brown fox jumps"), (1, 2, "quick brown"), (1, 3, "fox"), (1, 4, "the quick brown fox jumps"), (1, 5, None), (1, 6, ""), (2, 7, "fox")]
    got = folds.collapsed(spark.createDataFrame(blocks, "g long, i long, t string"), "g", "i", F.col("t"))
    assert rows_of(got.where("kept"), "i") == [(1,), (3,), (5,), (7,)]


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_ROWS", 7)
    monkeypatch.setattr(search, "TILE_QUERIES", 5)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), int(i % 3)) for i in range(40)]
    odd = [(100, None, 0), (101, [float("nan"), 1.0, 1.0, 1.0], 0), (102, [1.0], 1), (103, [], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (104, [1.0, None, 1.0, 1.0], 2)]
    v = search.vectors(spark.createDataFrame(rows + odd, "id long, e array<double>, g int"), "id", "e", "g")
    unit = {i: np.array(e) / (np.linalg.norm(e) or 1) for i, e, _ in rows}
    group = {i: g for i, _, g in rows}
    rules = {"any": lambda a, b: True, "same": lambda a, b: group[a] == group[b], "other": lambda a, b: group[a] != group[b], "earlier": lambda a, b: b < a}
    for rule, ok in rules.items():
        want = []
        for a in unit:
            near = sorted((-round(float(unit[a] @ unit[b]), 6) + 0.0, b) for b in unit if a != b and ok(a, b))[:3]
            want += [(a, b, -s + 0.0, i + 1) for i, (s, b) in enumerate(near)]
        assert rows_of(search.nearest(v.where("id < 100"), v.where("id < 100"), 3, rule), "query", "id", "score", "rank") == sorted(want, key=repr)
    assert search.nearest(v.where("id = 102"), v, 3).count() == 0 and search.nearest(v.limit(0), v, 3).count() == 0


def test_claims_of_any_length(spark):
    claims = spark.createDataFrame([(1, "one two"), (2, "Zero  one two three four five six"), (3, "ne two"), (4, ""), (5, None), (6, "six")], "id long, t string")
    sources = spark.createDataFrame([(10, "zero one two three four five six"), (11, "one\ttwo"), (12, None), (13, "")], "id long, t string")
    assert rows_of(retrieval.contained_in(claims, sources, "id", "id", "t"), "claim", "source") == [(1, 10), (1, 11), (2, 10), (6, 10)]
    assert retrieval.contained_in(claims.limit(0), sources, "id", "id", "t").count() == 0


def test_phrases_at_the_ends_of_texts(spark):
    phrases = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "b c d"), (4, ""), (5, None), (6, "d e")], "query long, phrase string")
    docs = spark.createDataFrame([(10, ["a", "b", "c", "d"]), (11, ["d"]), (12, []), (13, None)], "doc long, w array<string>")
    assert rows_of(search.phrase_matches(phrases, docs), "query", "doc") == [(1, 10), (2, 10), (3, 10)]


def test_mcnemar_of_large_counts(spark):
    def tail(n, k):
        return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))

    counts = [(0, 0), (1, 0), (3, 5), (900, 1000), (4900, 5100), (40000, 40400)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(counts)], "g long, a long, b long")
    each = pairs.select("g", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("a")), lambda x: F.lit(1)), F.transform(F.sequence(F.lit(0), F.col("b")), lambda x: F.lit(0)))).alias("x"))
    found = {r["g"]: r["p"] for r in scoring.mcnemar(each.withColumn("y", 1 - F.col("x")), "g", "x", "y").collect()}
    assert found == {i: pytest.approx(tail(a + b + 2, min(a, b) + 1), abs=2e-6) for i, (a, b) in enumerate(counts)}


def test_chains_cycles_and_readiness(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (7, 8), (7, 8)], "source long, target long")
    got = {r["id"]: (r["head"], r["place"]) for r in walks.mainline_order(nodes, links, "id").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (None, None), 6: (None, None), 7: (7, 0), 8: (7, 1)}
    deps = spark.createDataFrame([(2, 1, True), (3, 2, True), (3, 9, False), (4, 9, True)], "target long, source long, hard boolean")
    status = spark.createDataFrame([(1, "Done"), (2, "Dropped")], "node long, status string")
    assert rows_of(walks.readiness(deps, status), "target", "n_satisfied", "n_waiting", "n_blocked", "ready") == [(2, 1, 0, 0, True), (3, 0, 0, 1, False), (4, 0, 1, 0, False)]
    chain = spark.createDataFrame([(i + 1, i) for i in range(20)], "target long, source long")
    assert walks.blocked(chain, spark.createDataFrame([(4,)], "node long")).count() == 17


def test_bootstrap_bounds(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "c string, v double")
    r = answers.cluster_bootstrap(rows, "c", "v", 100, 13).first()
    assert (r["n_clusters"], r["mean"]) == (2, 3.0) and 2.0 <= r["low"] <= r["high"] <= 5.0
    one = answers.cluster_bootstrap(rows.where("c = 'b'"), "c", "v", 100, 13).first()
    assert (one["mean"], one["low"], one["high"]) == (5.0, 5.0, 5.0)
    assert answers.cluster_bootstrap(rows.limit(0), "c", "v", 100, 13).count() == 0
    many = answers.sign_flip_test(spark.range(15).withColumn("d", F.lit(1.0)), "id", "d").first()  # beyond 14 pairs the patterns are sampled
    assert (many["n"], many["mean"]) == (15, 1.0) and many["p"] <= 0.002


def test_leaks_at_any_depth(spark):
    rows = spark.sql("""SELECT 1L AS id, named_struct('gold', 'x', 'a', array(named_struct('GOLD', 1))) AS s, array(map('gold', 1, 'ok', 2)) AS m, CAST(NULL AS STRING) AS gold
      UNION ALL SELECT 2L, NULL, NULL, 'here'""")
    assert rows_of(adapters.leaks(rows, "id", ["Gold"]), "id", "path") == [(1, "m[].gold"), (1, "s.a[].GOLD"), (1, "s.gold"), (2, "gold")]


def test_strata_are_cut_before_the_shuffle(spark):
    docs = records.table(spark, SF, "documents")
    for df in (selection.interleaved(docs, "source", "doc_id", 20), selection.round_robin(docs, "source", "doc_id", 20), selection.proportional(docs, "source", "doc_id", 20)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_graph_documents_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("g", "L1_Step1", "L1", "a"), ("g", "L2_Step7", "L2", None), ("h", "x", "L1", "")], "graph string, node_id string, level string, content string")
    edges = spark.createDataFrame([("g", "L1_Step1", "L2_Step7", "INCLUSION")], "graph string, source string, target string, edge_type string")
    artifacts.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e, following = artifacts.graph_tables(artifacts.graph_documents(*artifacts.read_graph(spark, str(tmp_path / "g"))))
    assert rows_of(n, *nodes.columns) == rows_of(nodes, *nodes.columns) and rows_of(e, *edges.columns) == rows_of(edges, *edges.columns)
    assert rows_of(following, "graph", "level", "next_id") == [("g", "L1", 2), ("g", "L2", 8), ("h", "L1", 1)]


def test_vector_index_round_trip(spark, tmp_path):
    rows = records.table(spark, SF, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"))
    made = artifacts.write_vectors(rows, str(tmp_path / "v"), "flat").first()
    assert (made["n"], made["dimension"], made["index"]) == (rows.count(), 64, "flat")
    vectors, check = artifacts.read_vectors(spark, str(tmp_path / "v"))
    assert check.first()["intact"] and vectors.count() == rows.count()
    vectors.limit(1).write.mode("append").parquet(str(tmp_path / "v/vectors"))
    assert not artifacts.read_vectors(spark, str(tmp_path / "v"))[1].first()["intact"]


def test_numbered_texts_and_nested_labels(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"chapter_{i}.txt").write_text(f"text {i}\nmore")
    texts, check = artifacts.numbered_texts(spark, str(tmp_path))
    assert rows_of(texts, "number", "text") == [(i, f"text {i}\nmore") for i in (1, 2, 3)] and check.first()["complete"]
    (tmp_path / "chapter_9.txt").write_text("x")
    assert not artifacts.numbered_texts(spark, str(tmp_path))[1].first()["complete"]
    rows = spark.createDataFrame([('{"q1": {"is_solved": {"0": "Solved", "1": "Unsure"}}, "q2": {"is_solved": {}}}',), ("no json",), (None,)], "body string")
    assert rows_of(artifacts.solved_labels(rows, "body"), "query", "round", "label") == [("q1", "0", "Solved"), ("q1", "1", "Unsure")]


def test_scans_of_wrapped_and_bad_records(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.json").write_text('{"version": 1, "data": [{"x": 1}, {"x": 2}], "extra": [{"y": "z"}]}')
    wrapped = records.scan(spark, str(tmp_path / "w"), "wrapped", "*.json")
    assert rows_of(wrapped, "_source_stem", "_list", "x", "y") == [("a", "data", 1, None), ("a", "data", 2, None), ("a", "extra", None, "z")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/b.jsonl").write_text('{"x": 1}\n{bad\n{"x": 3}\n')
    lines = records.scan(spark, str(tmp_path / "l"), "jsonl", "*.jsonl").cache()
    assert rows_of(records.corrupt_counts(lines), "_source_file", "n", "n_corrupt") == [("b.jsonl", 3, 1)]
    assert records.scan(spark, str(tmp_path / "l"), "jsonl", "*.jsonl", limit=2).count() == 2


def test_wide_csv(spark, tmp_path):
    docs = records.table(spark, SF, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    names = records.write_wide_csv(docs, "lang", "source", "n", str(tmp_path / "m"))
    back = records.scan(spark, str(tmp_path / "m"), "csv", "*.csv")
    assert len(names) == docs.select("source").distinct().count() and sum(r[c] or 0 for r in back.collect() for c in names) == records.table(spark, SF, "documents").count()
    with pytest.raises(ValueError, match="more than 3"):
        records.write_wide_csv(docs, "lang", "source", "n", str(tmp_path / "n"), most=3)


def test_term_hits_inside_words_and_the_last_documents(spark):
    docs = spark.createDataFrame([(1, "Cathedral dog"), (2, None), (3, "cat"), (4, ""), (None, "cat dog")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "cat dog"), (8, "zebra"), (9, None), (None, "cat")], "item_id long, text string")
    got = retrieval.term_hits(asked, docs, "item_id", "doc_id", "text", 2, fall_back=True)
    assert rows_of(got, "query", "doc", "hits", "rank") == [(7, 1, 2, 1), (7, 3, 1, 2), (8, 3, 0, 2), (8, 4, 0, 1), (9, 3, 0, 2), (9, 4, 0, 1)]
    assert retrieval.term_hits(asked.limit(0), docs, "item_id", "doc_id", "text", 2).count() == 0


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    run = lambda: rows_of(catalogue.QUERIES["g5_idf_routing"](spark, SF), "query", "doc", "score", "rank")
    want = run()
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 300)
    assert run() == want


def test_nearest_dated_against_brute_force(spark):
    rng = np.random.default_rng(3)
    days = [f"2020-01-{d:02d}" for d in rng.integers(1, 12, 40)]
    rows = [(int(k), i, d) for i, (k, d) in enumerate(zip(rng.integers(0, 3, 40), days))]
    table = spark.createDataFrame([*rows, (0, 90, None), (None, 91, "2020-01-01")], "k long, id long, d string")
    want = []
    for k, i, d in rows:
        others = [(abs(int(d[-2:]) - int(e[-2:])), j) for g, j, e in rows if g == k and j != i]
        want += [(i, min(others)[1], min(others)[0])] if others else []
    assert rows_of(retrieval.nearest_dated(table, table, "k", "id", "d", "id", "d"), "query", "row", "days") == sorted(want, key=repr)


def test_two_hop_has_floor_relations_and_no_loops(spark):
    rows = [("a", "m", "x", 0.1), ("m", "b", "x", 0.9), ("a", "n", "x", 0.8), ("n", "b", "x", None), ("a", "z", "other", 1.0), ("m", "m", "x", 1.0), ("b", "m", "x", 0.5)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, weight double")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert rows_of(graphs.two_hop(edges, seeds, ["x"]), "source", "target", "middle", "weight") == [("a", "b", "m", 0.405)]


def test_same_group_search_in_small_tiles(spark, monkeypatch):
    rows = search.vectors(records.table(spark, SF, "embeddings"), "vec_id", "embedding", "label")
    run = lambda: rows_of(search.nearest(rows, rows, 3, "same", 9), "query", "id", "score", "rank")
    want = run()
    monkeypatch.setattr(search, "TILE_QUERIES", 16)
    monkeypatch.setattr(search, "TILE_ROWS", 20)
    assert run() == want


def test_capped_edges_against_brute_force(spark):
    rows = search.vectors(records.table(spark, SF, "embeddings"), "vec_id", "embedding", "label")
    of = {r["id"]: r["group"] for r in rows.collect()}
    pairs = [(r["a"], r["b"], r["score"]) for r in search.undirected(search.nearest(rows, rows, 5, "same"), 0.0).collect()]
    degree, want = collections.Counter(), []
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if degree[a] < 3 and degree[b] < 3:
            degree.update((a, b))
            want.append((of[a], a, b, score))
    assert rows_of(catalogue.QUERIES["e18_capped_edges"](spark, SF), "group", "a", "b", "score") == sorted(want, key=repr)


def test_sources_and_decisions_on_odd_rows(spark):
    texts = spark.createDataFrame([(1, "In The Daily Post - today"), (2, None), (3, "daily, and post daily")], "id long, text string")
    names = spark.createDataFrame([("The Daily Post | World",), ("Daily",), (None,), ("x",)], "name string")
    assert rows_of(relations.mentioned_sources(texts, names, "id", "text", "name"), "query", "alias") == [(1, "the daily post"), (3, "daily")]
    asked = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, None)], "t long, source long, same_key boolean")
    made = [(1, 1, "c", 0.5, "r"), (1, 2, "d", 2.0, "r"), (1, 4, None, 0.5, "r"), (1, 9, "c", 0.5, "r"), (2, 2, "c", 0.1, " ")]
    made = spark.createDataFrame(made, "t long, source long, kind string, confidence double, reason string")
    want = [(1, 1, "accepted"), (1, 2, "confidence"), (1, 3, "missing"), (1, 4, "kind"), (1, 9, "unknown"), (2, 2, "unknown")]
    assert rows_of(relations.checked_decisions(asked, made, ["t"], ["c", "d"], "c"), "t", "source", "verdict") == want
    assert rows_of(relations.checked_decisions(asked, made.union(made), ["t"], ["c", "d"], "c").where("source = 1"), "verdict") == [("repeated",), ("repeated",)]


def test_relations_of_near_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.6), (1, 4, 0.9), (2, 4, 0.42), (3, 4, 0.43)], "a long, b long, score double")
    names = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "x"), (4, "y")], "id long, alias string")
    salient = spark.createDataFrame([(1, "t"), (2, "t"), (4, "t")], "id long, term string")
    want = [(1, 2, "same_entity_event", 1, 1), (1, 3, "same_entity_event", 1, 0), (1, 4, "same_attribute", 0, 1)]
    assert rows_of(relations.related_pairs(pairs, names, salient), "a", "b", "relation", "n_entities", "n_terms") == want
    assert relations.related_pairs(pairs, names.limit(0), salient.limit(0)).count() == 0
