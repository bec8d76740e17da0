"""LM scoring by deleted interpolation of bigrams, unigrams and a uniform floor.

    P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1),    b = floor(log2(c(h) + 1)),    l2(0) = 0

The counts are those of all training texts. The weights of each context-frequency bucket b are learned by
expectation-maximisation: a seventh of all rows, all of them training rows, is deleted from the counts, and the weights maximise its
likelihood under what is left. Contexts are dealt over shards by hash. Each shard bins its deleted bigrams by (b, estimates); the
bins' sums over all shards give one set of weights, with which a second pass over the same shuffle scores.

Bigrams are not rows: a task hands each shard packed arrays (64-bit keys, the text's number, a count), which numpy sorts.
Words are 64-bit hashes; a bigram's key holds 32 bits of the context besides the shard, and 32 of the word.

1. Unigram counts, added up in each task before the shuffle; the `TOP` most frequent words are broadcast (a fixed size).
   The bigrams of the words below meet the counts in a shuffle by word, which sends the counts on to the bigrams' shards: every
   word has its own count, and unseen words have the floor alone.
2. One shuffle brings bigrams to their context's shard. A context above a quarter of a shard's share is split by its words,
   with its total from step 1.
3. Partial sums meet again by text.

Null texts are empty: their only token is the end. A null doc_id is a training row of fold 0. Repeated rows count and are scored each.
Without training tokens (N = 0) every score is that of the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, batches, documents, load, materialize, mix, slices

#: Values of counts up to which their codes have 16 bits.
NARROW = 1 << 16
TOP, SHARD_TOKENS, FOLD_ROWS, STEPS, CLASSES, MERGE_AT = 1 << 20, 1_200_000, 12, 15, 48, 600_000
END = U64(0x5DEECE66D1234567)
_LEVELS = np.unique(np.round(2.0 ** np.arange(0, 44, 0.5))).astype(np.int64)
_UNIGRAMS = "kind int, bucket int, keys binary, counts binary, levels array<long>, n long, n_kept long"
_PACKED = "kind int, bucket int, base long, keys binary, at binary, n binary, code binary, more binary"
_COUNTS = "kind int, bucket int, base long, keys binary, code binary"
_BINS = "b int, cells binary, sums binary"
_PART = "bucket int, kind int, rows binary, ids binary, n binary, known binary, base binary, score binary"


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, the end token after each, and where each text begins."""
    w = Words(texts, lower=True)
    off = w.off + np.arange(len(w.off))
    out = np.full(int(off[-1]), END, U64)
    inside = np.ones(len(out), bool)
    inside[off[1:] - 1] = False
    out[inside] = w.hashes()
    return out, off


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of counts."""
    k = np.concatenate(keys)
    order = np.argsort(k)
    k, c = k[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first, axis=0) if len(k) else c


def _unigrams(buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def packed() -> pa.RecordBatch:
            k, c = _counted(keys, counts)
            rows = [(1, i, k[o].tobytes(), c[o].tobytes(), [], 0, 0) for i, o in _split((k % U64(buckets)).astype(np.int64))]
            return _rows(rows, ["kind", "bucket", "keys", "counts", "levels", "n", "n_kept"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()])

        for part in slices(parts):
            tok, off = _tokens(part.column("text").to_pylist())
            fold = np.repeat(part.column("fold").to_numpy(), np.diff(off))
            k, inverse = np.unique(tok[fold > 0], return_inverse=True)
            of = fold[fold > 0]
            keys.append(k)
            counts.append(np.stack([np.bincount(inverse[of == f], minlength=len(k)) for f in (1, 2)], 1).astype(np.int64))
            held += len(k)
            if held > MERGE_AT:
                k, c = _counted(keys, counts)
                keys, counts, held = [k], [c], 0 if len(k) < MERGE_AT else held
                if len(k) >= MERGE_AT:
                    yield packed()
                    keys, counts, held = [], [], 0
        if keys:
            yield packed()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        k, c = _counted([np.frombuffer(x, U64) for x in group["keys"]], [np.frombuffer(x, np.int64).reshape(-1, 2) for x in group["counts"]])
        total = np.sort(c.sum(1))
        return pd.DataFrame({"kind": [1], "bucket": [group["bucket"].iloc[0]], "keys": [k.tobytes()], "counts": [c.tobytes()], "levels": [(len(total) - np.searchsorted(total, _LEVELS)).tolist()], "n": [int(total.sum())], "n_kept": [int(c[:, 0].sum())]})

    return run, merge


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _look(top: dict, words: np.ndarray) -> np.ndarray:
    """Rows of the broadcast counts; -1: not among them."""
    keys = top["keys"]
    if not len(keys):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, at, -1)


def _codes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some counts, 0 first, and each count's place among them: 16 bits wide, or 32 where there are more values."""
    values = np.unique(np.append(c, 0))
    return values, np.searchsorted(values, c).astype(np.uint16 if len(values) <= NARROW else np.uint32)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that occur, and the places of each; its work does not grow with the number of buckets."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for i, a, b in zip(found.tolist(), first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
        yield i, order[a:b]


def _bigrams(part: pa.RecordBatch, top: dict, buckets: int) -> tuple:
    """Tokens, text offsets, each token's row of the broadcast counts, and its bigram's context, key, shard and whether that is split."""
    tok, off = _tokens(part.column("text").to_pylist())
    word, inverse = np.unique(tok, return_inverse=True)
    row = _look(top, word)[inverse]
    c = np.append(top["total"], 0)[row]
    # the end token stands before each text too
    before, left = np.concatenate(([END], tok[:-1])), np.concatenate(([0], c[:-1]))
    left[off[:-1]] = top["end"]
    before[off[:-1]] = END
    key = (before & U64(0xFFFFFFFF00000000)) | (tok >> U64(32))
    parts_of = np.maximum(1, np.ceil(left * (4.0 * buckets / max(1, top["n"])))).astype(U64)
    hot = parts_of > 1
    shard = np.where(hot, mix(before + (tok >> U64(7)) % parts_of), before & U64(0xFFFFFFFF)) % U64(buckets)
    return tok, off, row, before, key, shard.astype(np.int32), hot


def _emit_rare(shared, buckets: int):
    """The bigrams of words outside the broadcast ones, by the word's bucket: words, upper halves of contexts, shards."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            tok, _, row, _, key, shard, _ = _bigrams(part, shared.value, buckets)
            rare = np.flatnonzero(row < 0)
            rare = rare[np.unique(key[rare] ^ mix(tok[rare] + shard[rare].astype(U64)), return_index=True)[1]]
            out = [(1, i, 0, tok[rare[o]].tobytes(), np.stack([(key[rare[o]] >> U64(32)).astype(np.uint32), shard[rare[o]].astype(np.uint32)]).tobytes()) for i, o in _split((tok[rare] % U64(buckets)).astype(np.int32))]
            yield _rows(out, ["kind", "bucket", "base", "keys", "code"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _counts_for(buckets: int):
    """The counts (all, kept) of these bigrams' words, by shard."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        model, g = g[g["base"] < 0], g[g["base"] >= 0]
        if not len(model) or not len(g):
            return pd.DataFrame({"kind": [], "bucket": [], "base": [], "keys": [], "code": []})
        keys, count = np.frombuffer(model["keys"].iloc[0], U64), np.frombuffer(model["code"].iloc[0], np.int64).reshape(-1, 2)
        word = np.concatenate([np.frombuffer(x, U64) for x in g["keys"]])
        context, shard = np.concatenate([np.frombuffer(x, np.uint32).reshape(2, -1) for x in g["code"]], 1)
        at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
        seen = np.flatnonzero(keys[at] == word)
        key = context[seen].astype(U64) << U64(32) | word[seen] >> U64(32)
        first = np.unique(key ^ mix(word[seen] + shard[seen].astype(U64)), return_index=True)[1]
        key, at, shard = key[first], at[seen[first]], shard[seen[first]].astype(np.int32)
        counts = np.stack([count[at].sum(1), count[at, 0]], 1).astype(np.uint32)
        rows = [(0, i, -1, key[o].tobytes(), counts[o].tobytes()) for i, o in _split(shard)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "base", "keys", "code"])

    return run


def _emit(shared, buckets: int):
    """Rows (kind 0: bigrams, 2: the texts themselves) by bucket; code holds the words' counts, more those without the deleted fold for bigrams of that fold."""
    names, types = ["kind", "bucket", "base", "keys", "at", "n", "code", "more"], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, base = shared.value, TaskContext.get().partitionId() << 40
        for part in slices(parts):
            tok, off, row, before, key, shard, hot = _bigrams(part, top, buckets)
            lengths = np.diff(off)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            c = np.append(top["total"], 0)[row]
            out = []
            # the texts
            known = np.bincount(doc[c > 0], minlength=len(lengths))
            score = np.bincount(doc, weights=np.where(c > 0, np.log10(c + 1.0) - top["floor"], 0.0), minlength=len(lengths))
            ids = part.column("doc_id")
            fold = part.column("fold").to_numpy()
            more = np.concatenate([lengths.astype(np.int64), known.astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
            out.append((2, int(mix(np.array([base >> 12], U64))[0] % U64(buckets)), base, ids.fill_null(0).to_numpy().tobytes(), b"", score.tobytes(), b"", more.tobytes()))
            own = key ^ mix(before + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
            _, first, n = np.unique(own, return_index=True, return_counts=True)
            if n.max(initial=0) > 255:
                times = -(-n // 255)
                first, spread = np.repeat(first, times), np.repeat(n, times)
                lead = np.concatenate(([True], first[1:] != first[:-1]))
                n = np.where(lead, spread - 255 * (np.repeat(times, times) - 1), 255)
            key, row = key[first], row[first]
            deleted = fold[doc[first]] == 2
            at = (doc[first] | (fold[doc[first]].astype(np.int64) << FOLD_ROWS) | (hot[first].astype(np.int64) << 15)).astype(np.uint16)
            code, less = (np.append(top[x], top[x].dtype.type(0))[row] for x in ("code", "kept_code"))
            n = n.astype(np.uint8)
            for i, o in _split(shard[first]):
                out.append((0, i, base, key[o].tobytes(), at[o].tobytes(), n[o].tobytes(), code[o].tobytes(), less[o[deleted[o]]].tobytes()))
            base += 1 << FOLD_ROWS
            yield _rows(out, names, types)

    return run


def _cells(estimate: np.ndarray) -> np.ndarray:
    """Bins of a quarter of an octave each; 0: the estimate is 0."""
    return np.where(estimate > 0, 1 + np.floor(-4 * np.log2(np.where(estimate > 0, estimate, 1.0))), 0).astype(np.int64)


def _binned(b: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Deleted bigrams of each frequency bucket, as cells of equal bins: their count and the sums of both estimates."""
    cells, sums = _counted([(b << 32 | _cells(p2) << 16 | _cells(p1)).astype(U64)], [np.stack([n, n * p2, n * p1], 1)])
    of = (cells >> U64(32)).astype(np.int64)
    rows = [(i, cells[o].tobytes(), sums[o].tobytes()) for i, o in _split(of)]
    return pd.DataFrame(rows, columns=["b", "cells", "sums"])


def _summed(g: pd.DataFrame) -> pd.DataFrame:
    cells, sums = _counted([np.frombuffer(x, U64) for x in g["cells"]], [np.frombuffer(x).reshape(-1, 3) for x in g["sums"]])
    return pd.DataFrame({"b": [g["b"].iloc[0]], "cells": [cells.tobytes()], "sums": [sums.tobytes()]})


def _learn(uniform: float):
    """EM over the cells of all shards: weights of each frequency bucket, those without data from all together."""

    def em(b: np.ndarray, parts: np.ndarray, n: np.ndarray, buckets: int, start: np.ndarray) -> np.ndarray:
        weights = start.copy()
        for _ in range(STEPS):
            mixed = weights[b] * parts
            mixed *= (n / mixed.sum(1))[:, None]
            weights = np.stack([np.bincount(b, weights=mixed[:, j], minlength=buckets) for j in range(3)], 1) + 0.5 * start
            weights /= weights.sum(1, keepdims=True)
        return weights

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["b"] >= 0].sort_values("b")
        sums = np.concatenate([np.empty((0, 3)), *[np.frombuffer(x).reshape(-1, 3) for x in g["sums"]]])
        b = np.repeat(g["b"].to_numpy().astype(np.int64), [len(x) // 8 for x in g["cells"]])
        n = sums[:, 0]
        parts = np.stack([sums[:, 1] / n, sums[:, 2] / n, np.full(len(n), uniform)], 1)
        overall = em(np.zeros(len(b), np.int64), parts, n, 1, np.array([[0.3, 0.5, 0.2]]))
        weights = em(b, parts, n, CLASSES, np.repeat(overall, CLASSES, 0))
        weights[0, 0] = 0.0  # after a context that no training text has, bigrams have no share: the other two take it
        return pd.DataFrame({"weights": [(weights / weights.sum(1, keepdims=True)).tobytes()]})

    return run


def _reduce(shared, buckets: int):
    """The two passes over a group of the shuffle: the first bins its deleted bigrams, the second scores with the weights."""
    home = lambda base: (mix((base >> 12).astype(U64)) % U64(buckets)).astype(np.int64)

    def dealt(kind: int, rows: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        groups = list(_split(home(rows >> FOLD_ROWS << FOLD_ROWS)))
        pick = lambda x: [x[o].tobytes() for _, o in groups]
        return pd.DataFrame({"bucket": [i for i, _ in groups], "kind": kind, "rows": pick(rows), **{k: pick(columns[k]) if k in columns else b"" for k in ("ids", "n", "known", "base", "score")}})

    def bigrams(g: pd.DataFrame, top: dict, weights: np.ndarray | None) -> pd.DataFrame:
        rare, g = g[g["base"] < 0], g[g["base"] >= 0]
        if not len(g):
            return dealt(0, np.empty(0, np.int64), score=np.empty(0)) if weights is not None else pd.DataFrame({"b": [], "cells": [], "sums": []})
        key = np.concatenate([np.frombuffer(x, U64) for x in g["keys"]])
        at = np.concatenate([np.frombuffer(x, np.uint16) for x in g["at"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in g["n"]]).astype(np.float64)
        code = np.concatenate([np.frombuffer(x, top["code"].dtype) for x in g["code"]])
        less = np.zeros(len(key), code.dtype)
        less[(at >> FOLD_ROWS) & 3 == 2] = np.concatenate([np.frombuffer(x, code.dtype) for x in g["more"]])
        base = np.repeat(g["base"].to_numpy(), [len(x) // 8 for x in g["keys"]])
        order = np.argsort(key)
        key, at, n, code, less, base = key[order], at[order], n[order], code[order], less[order], base[order]
        fold = (at >> FOLD_ROWS) & 3
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        kept, deleted = (np.add.reduceat(n * (fold == f), first) for f in (1, 2))
        context = key[first] >> U64(32)
        lead = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        size = np.diff(np.append(lead, len(context)))
        of_kept, of_all = np.add.reduceat(kept, lead), np.add.reduceat(kept + deleted, lead)
        hot = at[first[lead]] >> 15 > 0
        if hot.any():
            row = np.searchsorted(top["hot"], context[lead[hot]])
            of_kept[hot], of_all[hot] = top["hot_kept"][row], top["hot_all"][row]
        of_kept, of_all = np.repeat(of_kept, size), np.repeat(of_all, size)
        c1, c1_kept = top["values"][code[first]], top["values"][np.maximum.reduceat(less, first)]
        outside = code[first] == 0
        if outside.any() and len(rare):
            their, count = _counted([np.frombuffer(x, U64) for x in rare["keys"]], [np.frombuffer(x, np.uint32).reshape(-1, 2).astype(np.int64) for x in rare["code"]])
            found = np.minimum(np.searchsorted(their, key[first]), len(their) - 1)
            found = np.where((their[found] == key[first]) & outside, found, -1)
            c1, c1_kept = (np.where(found >= 0, count[found, j], x) for j, x in ((0, c1), (1, c1_kept)))
        p1, p1_kept = c1 / max(1, top["n"]), c1_kept / max(1, top["kept"])
        bucket = lambda c: np.minimum(np.log2(c + 1), CLASSES - 1).astype(np.int64)
        share = lambda a, c: np.divide(a, c, out=np.zeros(len(a)), where=c > 0)
        if weights is None:
            use = np.flatnonzero(deleted > 0)
            return _binned(bucket(of_kept[use]), share(kept[use], of_kept[use]), p1_kept[use], deleted[use])
        w = weights[bucket(of_all)]
        value = np.log10(w[:, 0] * share(kept + deleted, of_all) + w[:, 1] * p1 + w[:, 2] * top["uniform"])
        each = np.repeat(value, np.diff(np.append(first, len(key)))) * n
        rows, inverse = np.unique(base + (at & 0xFFF), return_inverse=True)
        scored = dealt(0, rows, score=np.bincount(inverse, weights=each))
        # what the texts lack: words outside the broadcast ones
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        on = np.flatnonzero(outside[of])
        c, rows = c1[of[on]], base[on] + (at[on] & 0xFFF)
        rows, inverse = np.unique(rows, return_inverse=True)
        return pd.concat([scored, dealt(1, rows, known=np.bincount(inverse, weights=n[on] * (c > 0)).astype(np.int64), base=np.bincount(inverse, weights=n[on] * (np.log10(c + 1.0) - top["floor"])))])

    def texts(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for base, ids, score, more in zip(g["base"], g["keys"], g["n"], g["more"], strict=True):
            m = len(ids) // 8
            out.append((g["bucket"].iloc[0], 2, (base + np.arange(m)).tobytes(), ids, more[: 8 * m], more[8 * m : 16 * m], score, more[16 * m :]))
        return pd.DataFrame(out, columns=["bucket", "kind", "rows", "ids", "n", "known", "base", "score"])

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        return bigrams(g[g["kind"] == 0], shared.value, None)

    def score(g: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or g["kind"].iloc[0] == 2:
            return texts(g)
        return bigrams(g, shared.value, np.frombuffer(weights["weights"].iloc[0]).reshape(-1, 3))

    return learn, score


def _gather(g: pd.DataFrame) -> pd.DataFrame:
    own = g[g["kind"] == 2]
    if not len(own):
        return pd.DataFrame({"doc_id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
    of = lambda frame, column, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in frame[column]]])
    rows = of(own, "rows", np.int64)
    order = np.argsort(rows)
    sums = {"known": of(own, "known", np.int64).astype(float), "base": of(own, "base", np.float64), "score": np.zeros(len(rows))}
    for kind, column, dtype in ((1, "known", np.int64), (1, "base", np.float64), (0, "score", np.float64)):
        more = g[g["kind"] == kind]
        sums[column] += np.bincount(order[np.searchsorted(rows[order], of(more, "rows", np.int64))], weights=of(more, column, dtype), minlength=len(rows))
    ids = pd.array(of(own, "ids", np.int64), dtype="Int64")
    ids[of(own, "score", np.int64) > 0] = pd.NA
    return pd.DataFrame({"doc_id": ids, "n_tokens": of(own, "n", np.int64), "n_known": sums["known"].astype(np.int64), "base_score": sums["base"], "score": sums["score"]})


def log_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text.

    docs: doc_id, text and fold (0: not learned from; 1: counted; 2: counted, and held out while the weights are learned).
    """
    docs = documents(docs, "fold").withColumn("fold", F.col("fold").cast("int"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // (6 * SHARD_TOKENS)))
    run, merge = _unigrams(buckets)
    counts = materialize(batches(docs).mapInArrow(run, _UNIGRAMS).groupBy("bucket").applyInPandas(merge, _UNIGRAMS))
    n, kept = (int(x or 0) for x in counts.agg(F.sum("n"), F.sum("n_kept")).first())
    levels = np.array([r[1] for r in counts.select(F.posexplode("levels").alias("i", "c")).groupBy("i").sum("c").orderBy("i").toLocalIterator()] or [0])
    least = int(_LEVELS[np.flatnonzero(levels <= TOP)[0]]) if len(levels) > 1 else 1

    def frequent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, c in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist(), strict=True):
                k, c = np.frombuffer(k, U64), np.frombuffer(c, np.int64).reshape(-1, 2)
                on = c.sum(1) >= least
                yield pa.RecordBatch.from_arrays([pa.array([k[on].tobytes()], pa.binary()), pa.array([c[on].tobytes()], pa.binary())], ["keys", "counts"])

    found = counts.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()  # TOP words at most
    key, c = _counted([np.empty(0, U64), *[np.frombuffer(r[0], U64) for r in found]], [np.empty((0, 2), np.int64), *[np.frombuffer(r[1], np.int64).reshape(-1, 2) for r in found]])
    total, v = c.sum(1), int(levels[0])
    hot = np.ceil(total * (4.0 * buckets / max(1, n))) > 1
    order = np.argsort(key[hot] >> U64(32), kind="stable")
    end = total[np.flatnonzero(key == END)]
    values, codes = _codes(np.concatenate([total, c[:, 0]]))
    top = {
        "keys": key, "total": total, "n": n, "end": int(end[0]) if len(end) else 0, "uniform": 1.0 / (v + 1), "floor": float(np.log10(n + v + 1.0)),
        "kept": kept, "values": values, "code": codes[: len(key)], "kept_code": codes[len(key) :], "hot": (key[hot] >> U64(32))[order], "hot_kept": c[hot, 0][order].astype(float), "hot_all": total[hot][order].astype(float),
    }
    shared = spark.sparkContext.broadcast(top)
    known = counts.select("kind", "bucket", F.lit(-1).cast("long").alias("base"), "keys", F.col("counts").alias("code"))
    rare = batches(docs).mapInArrow(_emit_rare(shared, buckets), _COUNTS).union(known).groupBy("bucket").applyInPandas(_counts_for(buckets), _COUNTS)
    nothing = F.lit(b"")
    packed = batches(docs).mapInArrow(_emit(shared, buckets), _PACKED).union(rare.select("kind", "bucket", "base", "keys", nothing.alias("at"), nothing.alias("n"), "code", nothing.alias("more")))
    learn, score = _reduce(shared, buckets)
    none = spark.createDataFrame([(-1, b"", b"")], _BINS)
    bins = packed.groupBy("kind", "bucket").applyInPandas(learn, _BINS).groupBy("b").applyInPandas(_summed, _BINS)
    weights = bins.union(none).groupBy().applyInPandas(_learn(top["uniform"]), "weights binary")  # CLASSES rows at most
    weights = spark.range(buckets).select(F.lit(0).alias("kind"), F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(weights))
    parts = packed.groupBy("kind", "bucket").cogroup(weights.groupBy("kind", "bucket")).applyInPandas(score, _PART)
    out = parts.groupBy("bucket").applyInPandas(_gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 7
    folds = docs.select("doc_id", "text", F.when(rest == 2, 0).when(rest == 5, 2).otherwise(1).alias("fold"))
    scored = log_scores(folds)
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
