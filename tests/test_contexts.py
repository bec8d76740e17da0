"""Packed contexts, edges from decisions and bootstraps over single rows, against plain loops and on odd rows."""

import hashlib
from itertools import pairwise

import pytest

from palimpsest.operators import contexts as C
from palimpsest.operators import relations as L
from palimpsest.operators import resampling as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def weight(seed, key, r):
    """Poisson weights told from their share of 65,536, not by a table."""
    u, total, p, k = int.from_bytes(hashlib.md5(f"{seed}:{key}:{r // 8}".encode()).digest()[r % 8 * 2 : r % 8 * 2 + 2]), 0.0, 2.718281828459045**-1, 0
    while True:
        total += p
        if u < round(65536 * total):
            return k
        k += 1
        p /= k


def test_weights_are_poisson():
    drawn = [int(w) for key in range(400) for w in P.weights(1, str(key), 100)]
    assert drawn[:100] == [weight(1, "0", r) for r in range(100)]
    mean = sum(drawn) / len(drawn)
    assert abs(mean - 1) < 0.02 and abs(sum(w * w for w in drawn) / len(drawn) - mean**2 - 1) < 0.04
    assert all(a < b for a, b in pairwise(P.POISSON))


def test_mean_bootstrap_is_the_loop(spark):
    data = [("a", i, (i * 37 % 11) - 4.5) for i in range(40)] + [("a", 41, None), (None, 1, 3.0), (None, 2, 5.0), ("one", 9, 2.5), ("none", 1, None), ("nan", 1, float("nan"))]
    df = spark.createDataFrame(data, "g string, k long, v double")
    got = {r["g"]: r for r in P.mean_bootstrap(df, "g", "k", "v", 120, 5).collect()}
    assert set(got) == {"a", None, "one"} and got["one"]["low"] == got["one"]["high"] == got["one"]["mean"] == 2.5
    for g in ("a", None):
        of = [(k, v) for b, k, v in data if b == g and v is not None]
        drawn = [[(weight(5, k, r), v) for k, v in of] for r in range(120)]
        means = sorted(round(sum(w * v for w, v in d) / sum(w for w, _ in d), 9) for d in drawn if sum(w for w, _ in d))
        last = len(means) - 1
        assert (got[g]["n"], got[g]["low"], got[g]["high"]) == (len(of), round(means[int(0.025 * last)], 6), round(means[int(0.975 * last)], 6))
    spread = P.mean_bootstrap(df.repartition(7), "g", "k", "v", 120, 5)
    assert rows(spread) == sorted((tuple(r) for r in got.values()), key=repr)
    assert rows(P.mean_bootstrap(df.limit(0), "g", "k", "v", 20)) == []


def test_large_values_do_not_overflow(spark):
    df = spark.createDataFrame([("a", i, 9e8) for i in range(300)] + [("b", i, -9e8) for i in range(300)], "g string, k long, v double").coalesce(1)
    assert {(r["g"], r["low"], r["high"]) for r in P.mean_bootstrap(df, "g", "k", "v", 40).collect()} == {("a", 9e8, 9e8), ("b", -9e8, -9e8)}


@pytest.mark.parametrize("shift", [0.0, 2.0])
def test_stratified_p(spark, shift):
    data = [(s, f"{s}{i}", (i * 29 % 13) / 6 - 1 + shift) for s in "xyz" for i in range(12)]
    got = P.stratified_bootstrap(spark.createDataFrame(data, "s string, k string, v double"), "s", "k", "v", 200, 3).first()
    macro = []
    for r in range(200):
        each = []
        for s in "xyz":
            d = [(weight(3, k, r), v) for t, k, v in data if t == s]
            if sum(w for w, _ in d):
                each.append(round(sum(w * v for w, v in d) / sum(w for w, _ in d), 9))
        macro.append(round(sum(each) / len(each), 9))
    less = min(sum(m <= 0 for m in macro), sum(m >= 0 for m in macro))
    assert got["n_strata"] == 3 and got["p"] == pytest.approx(min(1, 2 * (less + 1) / 201), abs=1e-9)
    ordered = sorted(macro)
    assert (got["low"], got["high"]) == (pytest.approx(ordered[4], abs=1e-6), pytest.approx(ordered[195], abs=1e-6))
    assert got["p"] > 0.05 if shift == 0 else got["p"] == pytest.approx(2 / 201)


def test_no_differences_give_no_row(spark):
    assert rows(P.stratified_bootstrap(spark.createDataFrame([("x", 1, None)], "s string, k long, v double"), "s", "k", "v", 20)) == []


def test_hits_are_packed_whole(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 99, 1), (2, 12, 2)], "query long, item long, rank int")
    texts = spark.createDataFrame([(10, "a b c"), (11, "a b c d e"), (12, None), (13, "x y"), (13, "x"), (50, "z")], "id long, text string")
    assert rows(C.packed_hits(hits, texts, "query", "item", "rank", "id", "text", 5)) == [(1, 10, 3), (1, 12, 3), (1, 13, 5), (2, 12, 0)]
    assert rows(C.packed_hits(hits, texts.limit(0), "query", "item", "rank", "id", "text", 5)) == []


def test_schedules_cut_the_last_text(spark):
    items = spark.createDataFrame([("c", 1, "a b"), ("c", 1, "a"), ("c", 2, None), ("c", 3, "d, e f"), ("c", 4, "g")], "key string, pos long, text string")
    places = spark.createDataFrame([("c", 6, 0), ("c", 6, 1), ("c", 99, 0), ("d", 6, 0)], "key string, pos long, more int")
    assert rows(C.packed_schedule(items, places, "key", "pos", "text", 1, 5, 4)) == [("c", 6, 1, 2, False, "a b"), ("c", 6, 3, 2, True, "d ,")]


def test_accepted_decisions_become_edges_once(spark):
    verdicts = spark.createDataFrame([("t", "a", "accepted"), ("t", "b", "kind"), ("t", "c", "accepted"), ("u", "a", "missing")], "target string, source string, verdict string")
    made = spark.createDataFrame([("t", "a", "constraint", 0.5), ("t", "b", "odd", 0.5), ("t", "c", "plot_support", 1.0)], "target string, source string, kind string, confidence double")
    there = spark.createDataFrame([("t", "c"), (None, "a")], "target string, source string")
    assert rows(L.accepted_edges(verdicts, made, there, ["target"])) == [("t", "a", "DEPENDENCY", "constraint", 0.5)]
    assert len(rows(L.accepted_edges(verdicts, made, there.limit(0), ["target"]))) == 2
