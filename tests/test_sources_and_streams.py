from pyspark.sql import functions as F

from palimpsest.operators import search, segments, state
from palimpsest.sources import records
from palimpsest.streaming import memory
from palimpsest.streaming.registry import stream_versions

from .conftest import SF


def test_jsonl_round_trip(spark, tmp_path):
    rows = records.table(spark, SF, "benchmark")
    first = records.write_jsonl(rows, str(tmp_path / "out")).first()
    back = records.scan(spark, str(tmp_path / "out"), "jsonl", "*.json")
    assert {"_source_file", "_source_stem"} <= set(back.columns)
    again = records.digest(back.select("item_id", "text")).first()
    assert (first["n_rows"], first["content_sha256"]) == (again["n_rows"], again["content_sha256"])
    assert records.digest(rows.limit(0)).first()["n_rows"] == 0


def test_stream_equals_batch(spark, tmp_path):
    events = records.table(spark, SF, "events").select("user_id", "event_type", "event_id", "value").where("event_id < 400")
    for i in range(4):
        events.where(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = ["user_id", "event_type"]
    run = stream_versions(source, keys, "event_id", "value").writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    columns = [*keys, "version", "event_id", "value", "prior"]
    batch = state.versions(events, keys, "event_id", "value").select(*columns)
    assert sorted(map(tuple, spark.table("versions").select(*columns).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_windows_of_edge_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "a b c"), (5, "a b c d")], "doc_id long, text string")
    rows = segments.token_windows(docs, 3).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["start"], r["text"]) for r in rows] == [(3, 0, "a"), (4, 0, "a b c"), (5, 0, "a b c"), (5, 3, "d")]


def test_stream_memory_finds_what_came_before(spark, tmp_path):
    turns = records.table(spark, SF, "conversations").where("conv_id < 12").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    for i in range(3):
        turns.where(F.col("id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    path = str(tmp_path / "memory")
    embed = lambda c: search.hashed_bigrams(c, 32)
    for run in ("c", "again"):  # another checkpoint folder repeats the batches
        source = spark.readStream.schema(turns.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = memory.observed(source, "id", "text", embed, path).option("checkpointLocation", str(tmp_path / run)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    held = memory.memory(spark, path)
    assert sorted((r["id"], r["text"]) for r in held.select("id", "text").collect()) == sorted((r["id"], r["text"] or "") for r in turns.collect())
    rows, direct = (search.vectors(x, "id", "vec") for x in (held, turns.withColumn("vec", embed(F.col("text")))))
    asked = lambda x: sorted(map(tuple, search.nearest(x.where("id % 100 = 2"), x, 3, "earlier").collect()))
    assert asked(rows) == asked(direct) != []


def test_stream_takes_late_rows_and_leaves_out_null_orders(spark, tmp_path):
    batches = [[("k", 5, 1.0), ("k", None, 2.0)], [("k", 3, 3.0), ("k", 4, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, at long, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("key string, at long, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_versions(source, ["key"], "at", "value").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r["version"], r["at"], r["prior"]) for r in spark.table("late").collect()) == [(1, 5, None), (2, 3, 5), (3, 4, 3)]
