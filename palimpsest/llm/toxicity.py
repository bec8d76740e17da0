"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy.

A word's input joins an embedding of its hash with the mean embedding of its byte trigrams, so that unseen inflections
of known words score too. A text is cut into overlapping windows of 32 words (every 24th word starts one, the last ends
at the text's end), all of which are scored; the text's score is that of its worst window, calibrated on training texts.

Training is the only bounded part: at most `LABELLED` labelled rows of each class, the first by a hash of doc_id, and of these texts up to `MOST_BYTES` each and `SAMPLE_BYTES` in all.
Labels mark whole texts, so the network learns from the window of each toxic text that looks worst: at first by the odds of its
words and byte 5-grams, later by its own score.

Null texts are empty; an empty text is one window of padding. Rows without a label (or with a null one) are not learned from; repeated
rows are scored each. Without labelled rows of both classes every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, batches, documents, load, mix, slices

#: Labelled ids of a class, bytes of a text and of all texts of a class that the network is fitted on.
LABELLED, MOST_BYTES, SAMPLE_BYTES = 1500, 200_000, 24_000_000
LONG, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 32, 24, 8, 8, 12
WORD_ROWS, CHAR_ROWS, EPOCHS, STEPS, BATCH, RATE, ODDS_ROWS = 4096, 8192, 9, 400, 128, 0.01, 1 << 18


class Texts:
    """The distinct words of some texts with their input rows, and the windows as places in that list (-1: padding)."""

    def __init__(self, texts: list):
        w = Words(texts, lower=True)
        h = w.hashes()
        self.words, first, self.inverse = np.unique(h, return_index=True, return_inverse=True)
        self.word_rows = (self.words % U64(WORD_ROWS)).astype(np.int64)
        start, end = w.start[first], w.end[first]
        self.sizes = end - start + 1
        self.edge = np.concatenate(([0], np.cumsum(self.sizes)))
        # The bytes of each word with a space on both sides: as many trigrams as bytes, and one more than letters.
        at = np.repeat(start - 1 - self.edge[:-1], self.sizes) + np.arange(self.edge[-1])
        b = np.concatenate((np.array([32], np.uint8), w.bytes, np.array([32, 32], np.uint8))).astype(np.uint32)
        b[b < 33] = 32
        tri = (b[at + 1] << 16) | (b[at + 2] << 8) | b[at + 3]
        last = self.edge[1:] - 1
        tri[last] = (b[at[last] + 1] << 16) | (np.uint32(32) << 8) | 32
        self.char_rows = ((tri * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        self.off = w.off
        self._bytes, self._at = b, at

    def odds_rows(self) -> np.ndarray:
        """For the first choice of windows: a row for each byte 5-gram, by word as char_rows are."""
        b = self._bytes
        b = np.concatenate((b, np.full(4, 32, np.uint32))).astype(np.uint64)
        h = np.zeros(len(self._at), np.uint64)
        for i in range(5):
            h = h * U64(257) + b[self._at + 1 + i]
        return (mix(h) % U64(ODDS_ROWS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, LONG) places in the word list, and the text of each window."""
        starts, of = [], []
        for i, (a, b) in enumerate(zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True)):
            s = list(range(a, max(a, b - LONG) + 1, STRIDE))
            if s[-1] + LONG < b:
                s.append(b - LONG)
            starts += s
            of += [i] * len(s)
        at = np.array(starts, np.int64)[:, None] + np.arange(LONG)
        inside = at < self.off[1:][of][:, None]
        return np.where(inside, np.append(self.inverse, -1)[np.minimum(at, len(self.inverse))], -1), np.array(of)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    x, h = WORD_DIM + CHAR_DIM, HIDDEN
    shapes = {"word": (WORD_ROWS, WORD_DIM, 0.1), "char": (CHAR_ROWS, CHAR_DIM, 0.3), "wf": (x, 3 * h, 0.4), "uf": (h, 3 * h, 0.4), "bf": (3 * h,  0, 0), "wb": (x, 3 * h, 0.4), "ub": (h, 3 * h, 0.4), "bb": (3 * h, 0, 0), "a": (2 * h, h, 0.4), "v": (h, 0, 0.4), "o": (2 * h, 0, 0.4), "c": (1, 0, 0)}
    return {k: (rng.normal(0, 1, (n, m) if m else n) * s).astype(np.float32) for k, (n, m, s) in shapes.items()}


def _inputs(p: dict, t: Texts) -> np.ndarray:
    """Input vectors of the distinct words, and a row of zeros for padding at the end."""
    x = np.zeros((len(t.words) + 1, WORD_DIM + CHAR_DIM), np.float32)
    if len(t.words):
        x[:-1, :WORD_DIM] = p["word"][t.word_rows]
        x[:-1, WORD_DIM:] = np.add.reduceat(p["char"][t.char_rows], t.edge[:-1], axis=0) / t.sizes[:, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, HIDDEN) over projected inputs (steps, rows, 3 * HIDDEN)."""
    k = HIDDEN
    h, out = np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape[:2], k), np.float32)
    for i in range(len(x)):
        s = h @ u
        g = _sigmoid(x[i, :, : 2 * k] + s[:, : 2 * k])
        z, r = g[:, :k], g[:, k:]
        n = np.tanh(x[i, :, 2 * k :] + r * s[:, 2 * k :])
        if keep is not None:
            keep.append((h, z, r, n, s[:, 2 * k :]))
        h = n + z * (h - n)
        out[i] = h
    return out


def _gru_back(dh_all: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    k, du = HIDDEN, np.zeros_like(u)
    dx, dh = np.empty((*dh_all.shape[:2], 3 * k), np.float32), np.zeros_like(dh_all[0])
    for i in range(len(kept) - 1, -1, -1):
        h, z, r, n, s = kept[i]
        d = dh_all[i] + dh
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * s * r * (1 - r)
        dx[i] = np.concatenate((dz, dr, dn), 1)
        ds = np.concatenate((dz, dr, dn * r), 1)
        du += h.T @ ds
        dh = d * z + ds @ u.T
    return dx, du


def _forward(p: dict, xf: np.ndarray, xb: np.ndarray, pad: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: xf and xb are the projected inputs (steps, rows, 3 * HIDDEN) forwards and backwards in time."""
    kf, kb = ([], []) if keep is not None else (None, None)
    h = np.concatenate((_gru(xf, p["uf"], kf), _gru(xb, p["ub"], kb)[::-1]), 2)
    t = np.tanh(h @ p["a"])
    e = t @ p["v"] - 1e4 * pad
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = (e[:, :, None] * h).sum(0)
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, t=t, e=e, pooled=pooled)
    return pooled @ p["o"] + p["c"][0]


def _logits(p: dict, t: Texts, places: np.ndarray, rows: int = 2048) -> np.ndarray:
    x = _inputs(p, t)
    pf, pb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    out = np.empty(len(places), np.float32)
    for i in range(0, len(places), rows):
        at = places[i : i + rows].T
        out[i : i + rows] = _forward(p, pf[at], pb[at[::-1]], at < 0)
    return out


def _step(p: dict, t: Texts, places: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean log loss."""
    at, keep, g = places.T, {}, {k: np.zeros_like(v) for k, v in p.items()}
    words, local = np.unique(at, return_inverse=True)
    local = local.reshape(at.shape)
    real = words[words >= 0]
    sizes = t.sizes[real]
    chars = np.repeat(t.edge[:-1][real] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    x = np.zeros((len(words), WORD_DIM + CHAR_DIM), np.float32)
    skip = len(words) - len(real)
    x[skip:, :WORD_DIM] = p["word"][t.word_rows[real]]
    x[skip:, WORD_DIM:] = np.add.reduceat(p["char"][t.char_rows[chars]], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
    pf, pb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    score = _forward(p, pf[local], pb[local[::-1]], at < 0, keep)
    d = ((_sigmoid(score) - y) / len(y)).astype(np.float32)
    g["c"][0], g["o"] = d.sum(), keep["pooled"].T @ d
    h, e, tt = keep["h"], keep["e"], keep["t"]
    dp = d[:, None] * p["o"]
    de = (h * dp).sum(2)
    ds = e * (de - (e * de).sum(0))
    dt = ds[:, :, None] * p["v"] * (1 - tt * tt)
    g["v"], g["a"] = np.einsum("tb,tbk->k", ds, tt), np.einsum("tbi,tbk->ik", h, dt)
    dh = e[:, :, None] * dp + dt @ p["a"].T
    dxf, g["uf"] = _gru_back(dh[:, :, :HIDDEN], keep["kf"], p["uf"])
    dxb, g["ub"] = _gru_back(dh[::-1, :, HIDDEN:], keep["kb"], p["ub"])
    gf, gb = np.zeros_like(pf), np.zeros_like(pb)
    np.add.at(gf, local, dxf)
    np.add.at(gb, local[::-1], dxb)
    g["bf"], g["bb"], g["wf"], g["wb"] = gf.sum(0), gb.sum(0), x.T @ gf, x.T @ gb
    gx = (gf @ p["wf"].T + gb @ p["wb"].T)[skip:]
    np.add.at(g["word"], t.word_rows[real], gx[:, :WORD_DIM])
    np.add.at(g["char"], t.char_rows[chars], np.repeat(gx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
    return g, float(np.mean(np.logaddexp(0, score) - y * score))


def _first_choice(t: Texts, places: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A score for each window: the sum over its words of the largest log odds of their byte 5-grams."""
    rows, counts = t.odds_rows(), np.full((2, ODDS_ROWS), 0.5)
    for i in range(len(toxic)):
        words = np.unique(t.inverse[t.off[i] : t.off[i + 1]])
        if len(words):
            sizes = t.sizes[words]
            at = np.repeat(t.edge[:-1][words] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            counts[int(toxic[i]), np.unique(rows[at])] += 1
    odds = np.log(counts[1] / (toxic.sum() + 1)) - np.log(counts[0] / ((1 - toxic).sum() + 1))
    best = np.maximum.reduceat(odds[rows], t.edge[:-1]) if len(t.words) else np.empty(0)
    return np.append(np.maximum(best - 1, 0), 0.0)[places].sum(1)


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> dict:
    """The network's parameters, with the calibration `scale` and `shift` of a text's largest logit."""
    rng = np.random.default_rng(seed)
    p, toxic = _start(rng), np.asarray(toxic, np.int64)
    if not len(texts) or not 0 < toxic.sum() < len(toxic):
        rate = float(toxic.mean()) if len(toxic) else 0.0
        return p | {"scale": np.float32(0), "shift": np.float32(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))}
    t = Texts(texts)
    places, of = t.windows()
    edge = np.searchsorted(of, np.arange(len(texts) + 1))
    now = _first_choice(t, places, of, toxic)
    mean, var = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // (len(texts) + 2 * int((toxic == 0).sum()))))  # small samples go round more often
    for epoch in range(epochs):
        if epoch and epoch % (epochs // 3) == 0:
            now = _logits(p, t, places)
        worst = np.array([edge[i] + int(np.argmax(now[edge[i] : edge[i + 1]])) for i in range(len(texts))])
        clean = np.flatnonzero(toxic == 0)
        some = edge[clean] + (rng.random((2, len(clean))) * (edge[clean + 1] - edge[clean])).astype(np.int64)
        take = np.concatenate((worst, some.ravel()))
        label = np.concatenate((toxic, np.zeros(some.size, np.int64))).astype(np.float32)
        order = rng.permutation(len(take))
        for i in range(0, len(order), BATCH):
            o = order[i : i + BATCH]
            g, _ = _step(p, t, places[take[o]], label[o])
            step += 1
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                var[k] += 0.01 * (g[k] * g[k] - var[k])
                p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-7)
    top = np.maximum.reduceat(_logits(p, t, places), edge[:-1]).astype(float)
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a little shrinkage to (1, 0)
        q = 1 / (1 + np.exp(-np.clip(scale * top + shift, -30, 30)))
        w = q * (1 - q) + 1e-9
        grad = np.array([((q - toxic) * top).sum() + (scale - 1), (q - toxic).sum() + 0.1 * shift])
        hess = np.array([[(w * top * top).sum() + 1, (w * top).sum()], [(w * top).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        scale, shift = max(0.05, scale - float(np.clip(move[0], -1, 1))), shift - float(np.clip(move[1], -2, 2))
    return p | {"scale": np.float32(scale), "shift": np.float32(shift)}


def text_scores(p: dict, texts: list) -> np.ndarray:
    """A score between 0 and 1 for each text."""
    if not texts:
        return np.empty(0)
    t = Texts(texts)
    places, of = t.windows()
    top = np.maximum.reduceat(_logits(p, t, places), np.searchsorted(of, np.arange(len(texts))))
    return 1 / (1 + np.exp(-np.clip(p["scale"].astype(float) * top + float(p["shift"]), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels: of each class the first `most` labelled ids by their hash, with their texts of up to MOST_BYTES bytes, while a class has at most `most_bytes` of them.

    An id with several labels counts as toxic if one of them says so; of its texts the smallest counts. The driver gets these texts alone.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [r for y in (0, 1) for r in marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")  # 2 * most rows at most
    usable = documents(docs).where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(chosen), "doc_id")
    one = usable.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = one.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [r["text"] for r in found], np.array([r["toxic"] for r in found], np.int64)


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(text_scores(shared.value, part.column("text").to_pylist()), pa.float64())], ["doc_id", "text", "score"])

    return batches(documents(docs)).mapInArrow(score, "doc_id long, text string, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = load(spark, sf_dir, "labels")
    model = train(*labelled_sample(docs, labels.where(~held)))
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
