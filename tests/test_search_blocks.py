"""Vector search by streams of blocks: what is shuffled, odd groups, and groups beyond one block."""

import numpy as np

from palimpsest.operators import search
from tests.test_operators import rows_of


def shuffled(spark, run):
    """Bytes that tasks write to shuffles while run() runs."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_vectors_are_shuffled_once_not_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_QUERIES", 64)
    monkeypatch.setattr(search, "TILE_ROWS", 128)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist(), i % 7) for i in range(3000)]
    v = search.vectors(spark.createDataFrame(rows, "id long, e array<double>, g int"), "id", "e", "g")
    for rule in ("other", "same"):
        assert shuffled(spark, lambda: search.nearest(v, v, 3, rule).collect()) < 2.5 * 3000 * 64 * 8  # noqa: B023


def test_rows_without_group_are_in_no_other_group(spark):
    v = search.vectors(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, [1.0, 1.0], "b"), (4, [1.0, 1.0], None)], "id long, e array<double>, g string"), "id", "e", "g")
    assert rows_of(search.nearest(v, v, 2, "other"), "query", "id") == [(1, 3), (3, 1)]


def test_groups_of_all_sizes_and_repeated_ids_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_ROWS", 11)
    monkeypatch.setattr(search, "TILE_QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(i % 57, rng.integers(-1, 2, 3).astype(float).tolist(), ["x", "y", "z", None, "x"][i % 5] if i < 50 else f"g{i // 3}") for i in range(80)]
    v = search.vectors(spark.createDataFrame(rows, "id long, e array<double>, g string"), "id", "e", "g")
    asked = v.where("id % 2 = 0")
    unit = [(i, np.array(e) / (np.linalg.norm(e) or 1), g) for i, e, g in rows]
    rules = {"any": lambda a, b: True, "same": lambda a, b: a[2] == b[2] is not None, "same-earlier": lambda a, b: a[2] == b[2] is not None and b[0] < a[0]}
    for queries, mine in ((v, unit), (asked, [u for u in unit if u[0] % 2 == 0])):
        for rule, ok in rules.items():
            want = []
            for q in {i for i, _, _ in mine}:
                # a repeated query id pools its lists
                near = sorted((-round(float(a[1] @ b[1]), 6) + 0.0, b[0]) for a in mine if a[0] == q for b in unit if a[0] != b[0] and ok(a, b))[:4]
                want += [(q, b, -s + 0.0, i + 1) for i, (s, b) in enumerate(near)]
            assert rows_of(search.nearest(queries, v, 4, rule), "query", "id", "score", "rank") == sorted(want, key=repr), rule


def test_narrative_reads_the_texts_for_names_and_letters_once(spark):
    from palimpsest.plans import catalogue
    from tests.conftest import SF

    plan = catalogue.QUERIES["e17_narrative"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sf0.001/documents.parquet") <= 8  # four counts and four scans for terms; names and letters are tables by then


def test_bigrams_are_counted_once_not_for_each_bucket(spark):
    import time
    import zlib

    texts = ["añ😀b", "", None, "aaa", "x"]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", search.hashed_bigrams("t", 7).alias("v")).collect()
    for i, v in got:
        pairs = [a + b for a, b in zip(texts[i] or "", (texts[i] or "")[1:])]
        assert v == [sum(zlib.crc32(p.encode()) % 7 == d for p in pairs) for d in range(7)]
    start = time.time()
    spark.range(1).selectExpr("repeat('abcdefgh', 500000) t").select(search.hashed_bigrams("t")[0]).collect()
    assert time.time() - start < 8
