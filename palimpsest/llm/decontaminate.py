"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all benchmark items.

Normal form: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` joined by one space. Each document's normal form is
scanned once; what is found is mapped to word numbers and to character offsets of the original text.

The automaton is broadcast, so its size is checked first: the items' words are counted, and beyond `SHARD_WORDS` of them the items are dealt
over shards by hash. Each shard's automaton then scans the documents in a pass of its own, in which it is the only one that the driver
and the workers hold, and what the passes hit is put together by document. The result is the same.

Null or empty texts have no words and no hits. Items without words have no windows; null item ids take part under the name "null" only in
n_items' count of distinct items. Repeated items count once for each id. Repeated rows of documents are scanned each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, load, materialize, slices

#: Words of the windows in one automaton: some 200 MB in the driver and in each Python worker.
SHARD_WORDS = 2_000_000
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MADE = ("n_words", "n_hit", "items", "spans")
_SCHEMA = ", n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_SPACE).split(b" ")


def _form(text: str | None) -> bytes:
    return b" ".join([b"", *[w for w in words(text) if w], b""])


def windows(text: str | None, size: int) -> set[bytes]:
    """The normal forms of every `size` consecutive words; of fewer, but not none, the whole."""
    w = [x for x in words(text) if x]
    return {b" ".join([b"", *w[i : i + size], b""]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _patterns(items: DataFrame, size: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern -> (its words, its items)."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items.toLocalIterator():
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    return {w.decode("utf-8", "surrogatepass"): (w.count(b" ") - 1, sorted(who)) for w, who in owners.items()}


def _automaton(patterns: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        a.add_word(pattern, value)
    a.make_automaton()
    return a


def _hits(form: str, automaton) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, words, items) of each occurrence."""
    edges = None
    for end, (n, who) in automaton.iter(form):
        if edges is None:
            edges = np.flatnonzero(np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = int(np.searchsorted(edges, end))
        yield last - n, n, who


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character spans of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    on = np.concatenate(([False], np.frombuffer(raw.translate(_SPACE), np.uint8) != 32, [False]))
    start, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _scanned(text: str | None, automaton) -> tuple[int, np.ndarray | None, set[str]]:
    """The number of words, which of them are hit (None: none) and the items found."""
    form = _form(text)
    n, hit, who = max(0, form.count(b" ") - 1), None, set()
    if n and len(automaton):
        for first, m, found in _hits(form.decode("utf-8", "surrogatepass"), automaton):
            hit = np.zeros(n, bool) if hit is None else hit
            hit[first : first + m] = True
            who.update(found)
    return n, hit, who


def _with_results(part: pa.RecordBatch, found: list[tuple], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    texts, names = part.column("text").to_pylist(), [c for c in part.schema.names if c not in drop]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    made = [
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array([0 if hit is None else int(hit.sum()) for _, hit, _ in found], pa.int64()),
        pa.array([sorted(who) for _, _, who in found], pa.list_(pa.string())),
        pa.array([[] if hit is None else _spans(t, hit) for t, (_, hit, _) in zip(texts, found, strict=True)], spans),
    ]
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], [*names, *MADE])


def _in_passes(docs: DataFrame, items: DataFrame, size: int, shards: int) -> DataFrame:
    """The rows with `found`, a list of what the pass of each shard hit: places of words, and items."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    dealt, rows = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), None
    for i in range(shards):
        shared = docs.sparkSession.sparkContext.broadcast(_patterns(dealt.where(F.col("shard") == i).drop("shard"), size))

        def scan(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value)
            for part in slices(parts):
                found = [_scanned(t, automaton) for t in part.column("text").to_pylist()]
                on = pa.array([hit is not None for _, hit, _ in found], pa.bool_())
                places = pa.array([[] if hit is None else np.flatnonzero(hit) for _, hit, _ in found], pa.list_(pa.int32()))
                who = pa.array([sorted(w) for _, _, w in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), places, who], ["doc_id", "row", "places", "who"]).filter(on)

        one = materialize(batches(docs.select("doc_id", "row", "text")).mapInArrow(scan, "doc_id long, row long, places array<int>, who array<string>"))
        shared.unpersist()
        rows = one if rows is None else rows.union(one)
    rows = rows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("places", "who")).alias("found"))
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["doc_id"]) & (docs["row"] == rows["row"]), "left").drop(rows["doc_id"]).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, *more: str) -> DataFrame:
    """doc_id, text, the columns `more`, n_words, n_hit, items (sorted ids of the items with occurring windows), spans (hit words, as character offsets).

    Columns of `more` that are called like one of these get the suffix `_in`.
    """
    docs = documents(docs, *more, made=(*MADE, "row", "found"))
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + _SCHEMA
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item_id"), benchmark["text"].cast("string").alias("text")).distinct()
    n_words = items.agg(F.sum(size * F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    shards = -(-n_words // SHARD_WORDS)
    if shards > 1:

        def put_together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(parts):
                rows = []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                    n = max(0, _form(text).count(b" ") - 1)
                    hit = np.zeros(n, bool) if found else None
                    for f in found or ():
                        hit[f["places"]] = True
                    rows.append((n, hit, {w for f in found or () for w in f["who"]}))
                yield _with_results(part, rows, ("found",))

        return batches(_in_passes(docs, items, size, shards)).mapInArrow(put_together, result)
    shared = docs.sparkSession.sparkContext.broadcast(_patterns(items, size))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for part in slices(parts):
            yield _with_results(part, [_scanned(t, automaton) for t in part.column("text").to_pylist()])

    return batches(docs).mapInArrow(scan, result)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL: dict[str, str] = {
    "op6_decontaminate": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        n AS (SELECT DISTINCT len(g) AS k FROM p),
        o AS (SELECT doc_id, i, k, w[i:i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n WHERE len(w) >= k)),
        h AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM o JOIN p ON o.g = p.g),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
