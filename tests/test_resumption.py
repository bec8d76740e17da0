"""Builds that are stopped and resumed, and memory strategies whose stream equals the batch and goes on from its snapshot."""

import collections
import pathlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search as S
from palimpsest.sources import builds as B
from palimpsest.streaming import strategies as M

double = lambda rows: rows.select("id", (F.col("v") * 2).alias("w"))


def files(path):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("part-*")}


def test_a_resumed_build_rewrites_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i * i, i) for i in range(-50, 200)] + [(None, 1), (9, 77), (9, None)], "id long, v long")
    path = str(tmp_path / "t")
    assert B.built(rows, "id", path, double, 30, "twice", most=0) == 0
    assert B.built(rows, "id", path, double, 30, "twice", most=3) == 3
    before = files(path)
    with pytest.raises(ValueError, match="3 of"):
        B.finalised(spark, path)
    n = B.built(rows, "id", path, double, 30, "twice")
    assert n >= 6 and B.built(rows, "id", path, double, 30, "twice") == n
    after = files(path)
    assert all(after[p] == t for p, t in before.items())
    got = sorted(map(repr, ((r["id"], r["w"]) for r in B.finalised(spark, path).collect())))
    assert got == sorted(map(repr, ((r["id"], r["w"]) for r in double(rows.where("id is not null")).collect())))
    with pytest.raises(ValueError, match="something else"):
        B.built(rows, "id", path, double, 30, "thrice")


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    rows, path = spark.range(100).withColumn("v", F.col("id")), str(tmp_path / "t")

    def breaks(part):
        if part.agg(F.min("id")).first()[0] >= 20:
            double(part).limit(3).write.parquet(f"{path}/rows/batch=1")  # half a batch, no commit
            raise RuntimeError("gone")
        return double(part)

    with pytest.raises(RuntimeError):
        B.built(rows, "id", path, breaks, 25)
    B.built(rows, "id", path, double, 25)
    assert sorted(r["w"] for r in B.finalised(spark, path).collect()) == [2 * i for i in range(100)]


def test_finalising_refuses_gaps_and_changes(spark, tmp_path):
    rows, path = spark.range(100).withColumn("v", F.col("id")), tmp_path / "t"
    B.built(rows, "id", str(path), double, 25)
    (path / "commits/batch=1/_SUCCESS").rename(path / "aside")
    with pytest.raises(ValueError, match="1 of"):
        B.finalised(spark, str(path))
    (path / "aside").rename(path / "commits/batch=1/_SUCCESS")
    spark.createDataFrame([(1, 2)], "id long, w long").write.mode("append").parquet(str(path / "rows/batch=2"))
    with pytest.raises(ValueError, match="batch 2"):
        B.finalised(spark, str(path))
    with pytest.raises(ValueError, match="nothing was planned"):
        B.finalised(spark, str(tmp_path / "none"))
    empty = str(tmp_path / "empty")
    assert B.built(rows.limit(0), "id", empty, double, 25) == 0 and B.finalised(spark, empty).count() == 0


def turns():
    rng = np.random.default_rng(3)
    rows = []
    for subject in range(6):
        for place in range(12):
            n = int(rng.integers(0, 9))
            rows.append((subject, place, " ".join(f"w{x}" for x in rng.integers(0, 6, n)) if n else ["", None][place % 2]))
    return [*rows, (None, 1, "x"), (7, None, "x"), (8, 0, "only one"), (9, 5, "a " * 40), (9, 6, "b"), (9, 7, "c")]


STRATEGIES = {"recency": lambda: M.recency(12), "vector": lambda: M.vector(lambda c: S.hashed_bigrams(c, 16), 3, 12)}


@pytest.mark.parametrize("kind", sorted(STRATEGIES))
def test_stream_equals_batch_and_goes_on_from_its_snapshot(spark, tmp_path, kind):
    strategy, rows = STRATEGIES[kind](), turns()
    log = M.log_rows(spark.createDataFrame(rows, "subject long, place long, text string"), "subject", "place", "text")
    want = sorted(map(tuple, strategy.contexts(log, log).select("subject", "as_of", "place", "used").collect()))
    assert len(want) > 20
    source, path = tmp_path / "in", str(tmp_path / "memory")
    for run, places in enumerate((range(4), range(4, 7), range(7, 12))):  # each run is a new query: it has nothing but the snapshot and its checkpoint
        part = spark.createDataFrame([r for r in rows if r[1] is None or r[1] in places], "subject long, place long, text string")
        part.coalesce(1).write.mode("append").json(str(source))
        stream = M.log_rows(spark.readStream.schema("subject long, place long, text string").json(str(source)), "subject", "place", "text")
        M.remembered(stream, strategy, path).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert len(list((tmp_path / "memory/state").iterdir())) == min(2, run + 1)
    assert sorted(map(tuple, M.contexts(spark, path).collect())) == want
    kept = M.snapshot(spark, path, strategy)
    assert kept.count() < log.count() if kind == "recency" else kept.count() == log.count()
    with pytest.raises(ValueError, match="not of"):
        M.snapshot(spark, path, M.recency(13))


def test_vector_contexts_against_brute_force(spark):
    rows = [(s, p, t or "") for s, p, t in turns() if s is not None and p is not None]
    log = spark.createDataFrame(rows, "subject long, place long, text string")
    strategy, got = STRATEGIES["vector"](), collections.defaultdict(list)
    for r in strategy.contexts(log, log).orderBy("used").collect():
        got[r["subject"], r["as_of"]].append((r["place"], r["used"]))

    def embed(t):
        v = np.zeros(16)
        for a, b in zip(t, t[1:]):  # noqa: B905
            v[zlib.crc32((a + b).encode()) % 16] += 1
        return v / (np.linalg.norm(v) or 1)

    for s, p, t in rows:
        scored = sorted((-round(float(embed(t) @ embed(u)), 6), q) for o, q, u in rows if o == s and q < p)
        used, kept = 0, []
        for _, q in scored[:3]:
            n = len(next(u for o, x, u in rows if (o, x) == (s, q)).split())
            if used + n <= 12:
                used += n
                kept.append((q, used))
        assert sorted(got[s, p]) == sorted(kept)


def test_hashed_bigrams_are_linear_in_the_text(spark):
    took = []
    for words in (4000, 40000):
        frame = spark.createDataFrame([(i, f"word{i} été 日本 " * (words // 4)) for i in range(4)], "id int, text string").repartition(4)
        start = time.time()
        frame.select(F.sum(S.hashed_bigrams(F.col("text"))[0])).collect()
        took.append(time.time() - start)
    assert took[1] < 20
