"""Windows, marked units, graph neighbours and record checks on odd rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audits as U
from palimpsest.operators import graphs as G
from palimpsest.operators import segments as D
from palimpsest.operators import walks as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (7, 0), (5, 4), (6, 5), (100, 1)])
def test_windows_are_those_of_the_joined_text(spark, size, overlap):
    rng = random.Random(size)
    data = [(g, i, "".join(rng.choice("ab\ncé😀") for _ in range(rng.choice([0, 0, 1, 2, 9, 30])))) for g in ("x", "y", None) for i in range(9)]
    data += [("empty", 0, ""), ("one", 0, "q"), ("long", 0, "word " * 300), ("null", 0, None), ("null", 1, "z")]
    want, stride = [], size - overlap
    for g in {g for g, _, _ in data}:
        body = "\n".join(t for h, _, t in sorted((r for r in data if r[0] == g), key=lambda r: r[1]) if t is not None)
        want += [(g, k, s, body[s : s + size]) for k, s in enumerate(range(0, len(body), stride)) if k == 0 or len(body) - s > overlap]
    got = D.char_windows(spark.createDataFrame(data, "g string, o int, t string"), size, overlap, group="g", order="o", text=F.col("t"))
    assert rows(got) == sorted(want, key=repr)


def test_units_start_at_marked_lines(spark):
    data = [(1, "before\n# a \nrest\n# b"), (2, "# x"), (3, "none"), (4, None), (5, ""), (6, "a # b\n# \n\n")]
    assert rows(D.marked_units(spark.createDataFrame(data, "id long, text string"), "id", "text", "# ")) == [(1, 0, "# a \nrest"), (1, 1, "# b"), (2, 0, "# x"), (6, 0, "#")]


def test_nearest_ancestor_stops_at_the_first(spark):
    edges = spark.createDataFrame([("A", "b"), ("b", "c"), ("B", "c"), ("c", "d"), ("c", "d"), (None, "e"), ("e", "f"), ("f", "e"), ("A", "B")], "parent string, child string")
    levels = spark.createDataFrame([("A", "L1"), ("A", "L1"), ("B", "L1"), ("b", "L2")], "node string, level string")
    assert rows(W.nearest_ancestors(edges, levels, "L1", 5)) == [("B", "A", 1), ("b", "A", 1), ("c", "B", 1), ("d", "B", 2)]
    assert rows(W.nearest_ancestors(edges.limit(0), levels, "L1", 3)) == []


def test_related_takes_both_ends(spark):
    nodes = spark.createDataFrame([("a", "L1"), ("b", "L2")], "node string, level string")
    kind = "source string, target string, edge_type string, relation string"
    edges = spark.createDataFrame([("a", "b", "INCLUSION", None), ("a", "b", "INCLUSION", "x"), ("b", "z", "DEPENDENCY", None), (None, "b", "MAINLINE", None), ("a", "b", "OTHER", None)], kind)
    assert rows(G.related(nodes, edges)) == [("a", "child", "b", "L2"), ("b", "dependent", "z", None), ("b", "parent", "a", "L1"), ("z", "dependency", "b", "L2")]
    assert rows(G.graph_profile(nodes, edges)) == [
        ("edge_type", "DEPENDENCY", 1), ("edge_type", "INCLUSION", 2), ("edge_type", "MAINLINE", 1), ("edge_type", "OTHER", 1), ("level", "L1", 1), ("level", "L2", 1),
        ("relation", "dependency", 1), ("relation", "inclusion", 1), ("relation", "mainline", 1), ("relation", "other", 1), ("relation", "x", 1)]
    assert rows(G.related(nodes, edges.limit(0))) == [] and len(rows(G.graph_profile(nodes, edges.limit(0)))) == 2


def test_records_get_the_first_verdict(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, "abc"), (5, "abc"), (6, "abc")], "id long, text string")
    records = spark.createDataFrame([(1, 3, digest("abc")), (2, 9, "x"), (3, 0, digest("")), (4, 3, None), (6, 3, digest("abc")), (6, 3, digest("abc")), (7, 3, "x")], "id long, n_chars long, digest string")
    got = {r["id"]: r["verdict"] for r in U.record_check(texts, records, "id", "text", 1, 5).collect()}
    assert got == {1: "ok", 2: "length", 3: "band", 4: "digest", 5: "missing", 6: "repeated", 7: "no_text"}
