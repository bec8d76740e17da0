"""Quality classifier by a weak-label model.

1. Eight overlapping heuristic labellers vote on every text: bad, good or no vote. Votes are counted by pattern over all
   texts (3 ** 8 patterns at most, so the counts are bounded).
2. Expectation-maximisation over the pattern counts estimates each labeller's accuracy where it votes, with the labellers
   independent given the class; a pattern's posterior is the weak label of its texts.
3. The posteriors of a bounded sample (the first `SAMPLE` texts by a hash of doc_id and text) train a logistic scorer over hashed
   word shapes, which scores every text. Texts that score below 0.3 are rejected, so that doubtful short texts stay. The sample is
   picked by hash and turned into sparse counts in the tasks, so the driver gets `SAMPLE` small rows at any size of the input.

Repeated rows are scored each and are one row of the sample. Null and empty texts, and texts without words, get no votes and a score from the intercept alone. Without any text the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, batches, documents, load, mix, slices

SAMPLE, SAMPLE_BYTES, ROWS, EM_STEPS, FIT_STEPS, KEEP, FEW = 4000, 200_000, 1024, 60, 300, 0.3, 30.0
LABELLERS = ("symbols", "capitals", "repeats", "bare", "doubled", "variety", "short", "echo")
#: Labellers that vote on nearly every text start as less accurate than those that know one
#: kind of bad text, and are never trusted beyond 0.85: else two of them outvote every specialist on small tables.
BROAD = ("variety", "echo")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|!<>{}[]\\/=_^~@+", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_KIND = np.where(_UPPER, 1, np.where(_LETTER, 2, np.where((np.arange(256) >= 48) & (np.arange(256) <= 57), 3, np.where(_SYMBOL, 4, 5))))


def _vote(x: np.ndarray, bad_from: float, good_to: float = -np.inf) -> np.ndarray:
    """1: bad, 2: good, 0: no vote. Most labellers know bad texts only."""
    return np.where(x >= bad_from, 1, np.where(x <= good_to, 2, 0))


class Seen:
    """Votes and hashed shapes of some texts."""

    def __init__(self, texts: list):
        w, n_texts = Words(texts), len(texts)
        h, self.n = w.hashes(), np.diff(w.off)
        doc = np.repeat(np.arange(n_texts), self.n)
        share = lambda on: np.bincount(doc[on], minlength=n_texts) / np.maximum(self.n, 1)
        upto = lambda table: np.concatenate(([0], np.cumsum(table[w.bytes])))
        symbols, upper, letters = (upto(t)[w.end] - upto(t)[w.start] for t in (_SYMBOL, _UPPER, _LETTER))
        size = w.end - w.start
        first, last, before = w.bytes[w.start], w.bytes[w.end - 1], w.bytes[np.maximum(w.end - 2, 0)]
        again = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.empty(0, bool)
        again[w.off[:-1][self.n > 0]] = False
        doubled = (size > 2) & (last == before) & (_KIND[last] >= 4)
        by_bytes = lambda a: np.bincount(doc, weights=a, minlength=n_texts)
        total = np.maximum(by_bytes(size), 1)

        def distinct(h: np.ndarray) -> np.ndarray:
            return np.bincount(doc[np.unique(mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=n_texts)

        kinds, pairs = distinct(h), distinct(h ^ (np.roll(h, 1) << U64(1)))
        # Distinct words against what texts of this length have: of natural texts about n ** 0.8.
        variety = kinds / np.maximum(self.n, 1) ** 0.8
        votes = [
            _vote(by_bytes(symbols) / total, 0.07), _vote(by_bytes(upper) / np.maximum(by_bytes(letters), 1), 0.6), _vote(share(again), 0.25),
            _vote(share(letters == 0), 0.25), _vote(share(doubled), 0.3), np.where(self.n >= 30, _vote(-variety, -0.45, -0.8), 0),
            np.where(self.n >= 20, _vote(-share((size <= 3) & (letters > 0)), -0.1), 0),  # natural texts have short function words
            np.where(self.n >= 20, _vote(-pairs / np.maximum(self.n, 1) ** 0.95, -0.4, -0.7), 0),
        ]
        self.pattern = sum(np.where(self.n > 0, v, 0).astype(np.int64) * 3**i for i, v in enumerate(votes))
        crowd = np.minimum(2 * upper // np.maximum(letters, 1), 2)
        shape = _KIND[first] + 6 * (_KIND[last] + 6 * (doubled + 2 * (np.minimum(size, 15) // 4 + 4 * (crowd + 3 * (again + 2 * np.minimum(symbols, 3))))))
        self.row, self.doc, self.n_texts, self.off = (mix(shape.astype(U64)) % U64(ROWS)).astype(np.int64), doc, n_texts, w.off


def vote_posteriors(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """The chance that a pattern's texts are good, the labellers' accuracies where they vote, and the share of good texts."""
    pattern = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(p)] for p in pattern], float)
    votes = np.stack([pattern // 3**i % 3 for i in range(len(LABELLERS))], 1) if len(pattern) else np.empty((0, len(LABELLERS)), np.int64)
    broad = np.isin(LABELLERS, BROAD)
    right, good, post = np.where(broad, 0.7, 0.9), 0.8, np.full(len(pattern), 0.5)
    sign = np.array([0.0, -1.0, 1.0])[votes]
    for _ in range(EM_STEPS):
        post = 1 / (1 + np.exp(-np.clip(sign @ np.log(right / (1 - right)) + np.log(good / (1 - good)), -50, 50)))
        mass = weight[:, None] * (sign != 0)
        agree = (mass * np.where(sign > 0, post[:, None], 1 - post[:, None])).sum(0)
        right = np.clip((agree + 8) / (mass.sum(0) + 10), np.where(broad, 0.55, 0.7), np.where(broad, 0.85, 0.995))
        good = float(np.clip((weight * post).sum() / max(weight.sum(), 1), 0.05, 0.95))
    return dict(zip(pattern.tolist(), post.tolist(), strict=True)), right, good


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer for soft labels y, the last of them the intercept; accelerated gradient steps."""
    w = v = np.zeros(x.shape[1], np.float64)
    for i in range(FIT_STEPS):
        g = x.T @ (1 / (1 + np.exp(-(x @ v))) - y) / max(1, len(y)) + 1e-5 * v
        nxt = v - 2.0 * g
        v, w = nxt + i / (i + 3) * (nxt - w), nxt
    return w


MADE = ("n_words", "pattern", "weak", "score", "keep")
_ROW = "hash long, pattern long, cells binary, counts binary"


def _least_by_hash(docs: DataFrame, n_texts: int) -> list:
    """The first SAMPLE different texts by hash, as (hash, pattern, cells, counts): what the driver gets is bounded and holds no text.

    Only texts whose hash lies in the share that should hold them are looked at; where repeated rows leave too few, the share grows.
    """
    hashed = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.xxhash64("doc_id", "text").alias("hash"), "text")

    def shapes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            s = Seen(part.column("text").to_pylist())
            found = [np.unique(s.row[a:b], return_counts=True) for a, b in zip(s.off[:-1], s.off[1:], strict=True)]
            cells, counts = (pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary()) for i, kind in ((0, np.int16), (1, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array(s.pattern, pa.int64()), cells, counts], ["hash", "pattern", "cells", "counts"])

    share = 1.25 * SAMPLE / max(1, n_texts)
    while True:
        within = hashed if share >= 1 else hashed.where(F.col("hash") < int(-(2**63) + share * 2**64))
        rows = batches(within).mapInArrow(shapes, _ROW).dropDuplicates(["hash"]).orderBy("hash").limit(SAMPLE).collect()
        if len(rows) == SAMPLE or share >= 1:
            return rows
        share *= 4


def _dense(rows: list) -> np.ndarray:
    """The features of sampled texts: hashed shape frequencies and the intercept; a row's length nears 1 with the number of words."""
    x = np.zeros((len(rows), ROWS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["cells"], np.int16)] = np.frombuffer(r["counts"], np.int32)
    x /= np.sqrt((x * x).sum(1, keepdims=True) + FEW)
    x[:, ROWS] = 1
    return x


def quality_scores(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns `more`, n_words, pattern (votes), weak (posterior of its votes), score (chance of a good text), keep.

    Columns of `more` that are called like one of these get the suffix `_in`.
    """
    docs = documents(docs, *more, made=MADE)
    spark = docs.sparkSession

    def votes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            pattern = Seen(part.column("text").to_pylist()).pattern
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64())], ["pattern"])

    by_pattern = batches(docs.select("text")).mapInArrow(votes, "pattern long").groupBy("pattern").count()
    counts = {r[0]: r[1] for r in by_pattern.collect()}  # 3 ** 8 rows at most
    weak, _, _ = vote_posteriors(counts)
    sample = _least_by_hash(docs, sum(counts.values()))
    weights = fit(_dense(sample), np.array([weak[r["pattern"]] for r in sample]))
    shared = spark.sparkContext.broadcast((weak, weights))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, weights = shared.value
        for part in slices(parts):
            s = Seen(part.column("text").to_pylist())
            norm = np.zeros(s.n_texts)
            cell, n = np.unique(s.doc * ROWS + s.row, return_counts=True)
            np.add.at(norm, cell // ROWS, n.astype(float) ** 2)
            z = np.bincount(cell // ROWS, weights=n * weights[cell % ROWS], minlength=s.n_texts) / np.sqrt(norm + FEW) + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            made = [
                pa.array(s.n, pa.int64()),
                pa.array(s.pattern, pa.int64()),
                pa.array([weak.get(int(x), 0.5) for x in s.pattern], pa.float64()),
                pa.array(p, pa.float64()),
                pa.array(p >= KEEP),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *MADE])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return batches(docs).mapInArrow(score, f"{fields}, n_words long, pattern long, weak double, score double, keep boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "weak", "score", "keep")
