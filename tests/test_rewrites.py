"""Long chains, long texts, texts without blanks and clashing names: what an operator must stand."""

import collections
import difflib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import script_terms
from palimpsest.operators import answers, retrieval, search, walks
from palimpsest.plans import catalogue
from tests.conftest import SF


def test_wide_matrix_is_the_long_counts(spark):
    long = collections.defaultdict(int)
    for r in catalogue.QUERIES["a7_source_counts"](spark, SF).collect():
        long[r["lang"], r["source"]] = r["n"]
    wide = catalogue.QUERIES["a7_wide_matrix"](spark, SF)
    got = {(r["lang"], c): r[c] for r in wide.collect() for c in wide.columns if c != "lang"}
    assert got == {k: long.get(k, 0) for k in got} and sum(got.values()) == sum(n for (_, s), n in long.items() if s is not None)


def test_a_chain_of_thousands(spark):
    n = 5000
    order = list(range(n))
    random.Random(1).shuffle(order)
    nodes = spark.createDataFrame([(i,) for i in [*order, n, n + 1, n + 2, n + 3]], "id long")
    links = spark.createDataFrame([(a, b) for a, b in zip(order[:-1], order[1:], strict=True)] + [(n, n + 1), (n + 1, n), (n + 2, n + 3)], "source long, target long")
    start = time.time()
    got = {r["id"]: (r["head"], r["place"]) for r in walks.mainline_order(nodes, links, "id").collect()}
    assert time.time() - start < 120
    assert got == {x: (order[0], i) for i, x in enumerate(order)} | {n: (None, None), n + 1: (None, None), n + 2: (n + 2, 0), n + 3: (n + 2, 1)}
    assert walks.mainline_order(nodes.limit(0), links, "id").count() == 0


def test_blocked_is_what_can_be_reached(spark):
    rng = random.Random(2)
    deps = [(i + 1, i) for i in range(1500)] + [(rng.randrange(3000, 3300), rng.randrange(2900, 3300)) for _ in range(330)] + [(3300, 3301), (3301, 3300), (4000, None), (None, 5)]
    dropped = [700, 2950, 3010, 9999, None]
    after, want, todo = collections.defaultdict(set), set(), [d for d in dropped if d is not None]
    for t, s in deps:
        after[s].add(t)
    while todo:
        x = todo.pop()
        if x is not None and x not in want:
            want.add(x)
            todo += after[x]
    frame = spark.createDataFrame(deps, "target long, source long")
    got = [r["node"] for r in walks.blocked(frame, spark.createDataFrame([(d,) for d in dropped], "node long")).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    assert walks.blocked(frame, spark.createDataFrame([], "node long")).count() == 0


def terms(text):
    import regex

    out = []
    for run in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])[\p{L}\p{N}_])+", (text or "").lower()):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))] if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", run) else [run]
    return collections.Counter(out)


def cosine(a, b):
    a, b = terms(a), terms(b)
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return round(sum(a[t] * b[t] for t in a) / norm, 6) if norm else 0.0


TEXTS = ["The cat_1 sat, the CAT", "日本語のテキスト and words", "日本 語の text", "한국어 문장 문장", "", None, "x" * 50, "中文中文", "12 日3本", "été 日é"]


def test_terms_of_scripts_without_blanks(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    assert {r["id"]: collections.Counter(r["t"]) for r in rows.select("id", script_terms(F.col("text")).alias("t")).collect()} == {i: terms(t) for i, t in enumerate(TEXTS)}
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(10)] + [(1, 99), (None, 1), (1, 2)], "a int, b int")
    got = {(r["a"], r["b"]): r["cosine"] for r in search.sparse_cosine(pairs, rows, "id", F.col("text")).collect()}
    want = {(a, b): cosine(TEXTS[a], TEXTS[b]) for a in range(10) for b in range(10)} | {(1, 99): 0.0, (None, 1): 0.0}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_candidates_against_brute_force(spark):
    """Places across cells, paths, null keys, and column names that clash with the operator's own."""
    rng = random.Random(3)
    rows = [(g, i * 3, rng.choice(["k", "m", None]), " ".join(rng.choices(["日本", "cat", "dog", "Sun", "sky", "日"], k=rng.randrange(6))), rng.choice(["a/b/c", "a.b/d", "a", "x/b", None])) for g in ("p", "q") for i in range(23)] + [(None, 1, "k", "cat", "a")]
    frame = spark.createDataFrame(rows, "g string, o int, k string, t string, path string").withColumn("cell", F.lit(1)).withColumn("p", F.lit(2))
    got = {(r["g"], r["o"], r["source"]): (r["structural"], r["semantic"], r["referenced"], r["cosine"], r["rank"]) for r in search.channel_candidates(frame, "g", "o", "k", "t", 4, 2, 0.3, F.col("path"), 2).withColumnRenamed("target", "o").collect()}
    part = lambda p: [x for x in (p or "").replace(".", "/").split("/") if x][:2]
    want = {}
    for g in ("p", "q"):
        own = [r for r in rows if r[0] == g]
        for i, a in enumerate(own):
            found = []
            for j in range(max(0, i - 4), i):
                b, c = own[j], cosine(a[3], own[j][3])
                near, same = i - j <= 2 and len(part(a[4])) == 2 and part(a[4]) == part(b[4]), None if None in (a[2], b[2]) else a[2] == b[2]
                if near or c >= 0.3 or same:
                    found.append((-c, -b[1], near, same))
            for rank, (c, s, near, same) in enumerate(sorted(found, key=lambda x: x[:2]), 1):
                want[g, a[1], -s] = (near, -c >= 0.3, same, -c, rank)
    assert {k: v[:3] + v[4:] for k, v in got.items()} == {k: v[:3] + v[4:] for k, v in want.items()}
    assert [got[k][3] for k in want] == pytest.approx([v[3] for v in want.values()], abs=2e-6)


def test_long_turns_take_linear_work(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(1, i, "k", " ".join(f"w{rng.randrange(9000)}" for _ in range(8000))) for i in range(4)], "conv_id long, turn long, role string, text string")
    start = time.time()
    assert search.channel_candidates(rows, "conv_id", "turn", "role", "text", 8, 2, 0.18).count() == 6
    assert time.time() - start < 40


def test_common_subsequence_is_that_of_the_table():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert answers.common_subsequence(a, b) == table[-1][-1]
    words = [f"w{rng.randrange(5000)}" for _ in range(20000)]
    start = time.time()
    assert answers.common_subsequence(words, words[::-1]) >= max(m.size for m in difflib.SequenceMatcher(None, words[:50], words[:50]).get_matching_blocks()) / 50
    assert time.time() - start < 20


@pytest.mark.parametrize("name", ["g", "p", "sp", "real", "lcs", "same", "answer"])
def test_best_of_answers_takes_any_id_name(spark, name):
    rows = spark.createDataFrame([(1, "the cat sat", ["a cat", "the cat sat"]), (2, None, []), (3, "", None)], f"{name} int, text string, answers array<string>")
    got = {r[name]: (r["exact"], r["f1"]) for r in answers.best_of_answers(rows, name, "text", "answers").collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_centroids_of_named_groups(spark):
    rows = search.vectors(spark.createDataFrame([(1, [1.0, 0.0], "src"), (2, [0.0, 1.0], "src"), (3, [1.0, 0.0], "7")], "id long, v array<double>, g string"), "id", "v", "g")
    got = {r["group"]: r["vec"] for r in search.centroids(rows).collect()}
    assert got == {"src": pytest.approx([2**-0.5] * 2), "7": pytest.approx([1.0, 0.0])}
    assert {r["id"] for r in search.centroids(rows.where("id = 3")).collect()} == {7}


def test_lexical_search_in_small_pieces(spark, monkeypatch):
    """Blocks of queries and cuts of the held hits change nothing; names and numbers both serve as ids."""
    rng = random.Random(6)
    words = [f"w{i:03d}x" for i in range(60)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(70)] + [(3, "w001x"), (None, "w002x"), (71, None)]
    docs = [(f"d{i:02d}", " ".join(rng.choices(words, k=12))) for i in range(50)] + [("d03", "w001x w002x"), (None, "w003x"), ("e", None)]
    asked = spark.createDataFrame(queries, "q long, text string")
    have = spark.createDataFrame(docs, "d string, text string").repartition(3)
    pooled = collections.defaultdict(set)
    for q, t in queries:
        pooled[q] |= set((t or "").split())
    want = set()
    for q, terms_ in pooled.items():
        hits = sorted((-n, d) for d, t in docs if d is not None and q is not None and (n := sum(w in (t or "") for w in terms_)))[:4]
        want |= {(q, d, -n) for n, d in hits}
    for block, held in ((100_000, 500_000), (30, 10)):
        monkeypatch.setattr(retrieval, "BLOCK_TERMS", block)
        monkeypatch.setattr(retrieval, "HELD", held)
        got = {(r["query"], r["doc"], r["hits"]) for r in retrieval.term_hits(asked, have, "q", "d", "text", 4).collect()}
        assert got == want


def test_fifty_thousand_queries(spark):
    asked = spark.range(50_000).select(F.col("id"), F.format_string("term%d", F.col("id")).alias("text"))
    docs = spark.range(400).select(F.col("id").alias("d"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.format_string("term%d", F.col("id") * 7 + i)), " ").alias("text"))
    start = time.time()
    found = retrieval.idf_routing(asked, docs, "id", "d", "text", 3)
    assert found.agg(F.count_distinct("query")).first()[0] == 399 * 7 + 20
    assert time.time() - start < 90
