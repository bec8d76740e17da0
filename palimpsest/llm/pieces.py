"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The text gets a space in front, spaces become the marker U+2581, and the segmentation of the highest sum of log scores is
taken. Characters that no piece covers fall back to byte pieces. Decoding turns bytes and markers back; whatever has no
marker of its own comes back as it was.

A vocabulary file that orders its pieces by merge rank holds no probabilities; its pieces then take the log scores of
Zipf's law over their rank. No piece of such a file has the marker behind another character, so that best segmentations of single
words add up to the text's, and a worker keeps those of short words in a dictionary of bounded size.

Null texts are empty; empty texts have no pieces.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, load, slices

MARK, CACHE, SHORT, UNKNOWN = "▁", 400_000, 48, 10.0


class DoubleArray:
    """A trie of byte strings in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [1], [0], [-1]
        level: list[tuple[int, int, list[bytes]]] = [(0, 0, sorted(keys))]
        free = 1
        while level:
            following = []
            for state, depth, below in level:
                if below and len(below[0]) == depth:
                    self.value[state] = keys[below[0]]
                    below = below[1:]
                children: dict[int, list[bytes]] = {}
                for k in below:
                    children.setdefault(k[depth], []).append(k)
                if not children:
                    continue
                codes = list(children)
                while free < len(self.check) and self.check[free] >= 0:
                    free += 1
                base, tries = max(1, free - codes[0] - 1), 0
                while not all(base + c + 1 >= len(self.check) or self.check[base + c + 1] < 0 for c in codes):
                    base, tries = base + 1, tries + 1
                if tries > 200:  # what lies before is all but full
                    free = max(free, base + codes[0] + 1)
                self._grow(base + codes[-1] + 2)
                self.base[state] = base
                for c, k in children.items():
                    self.check[base + c + 1] = state
                    following.append((base + c + 1, depth + 1, k))
            level = following
        self._grow(max(self.base) + 258)

    def _grow(self, n: int) -> None:
        for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
            a.extend([fill] * (n - len(a)))


def read_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, log score, kind) by id; kind: normal, byte, unknown or control. The driver reads the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"
        out.append((model.id_to_piece(i), model.get_score(i), kind))
    return zipf(out)


def zipf(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """Log scores by Zipf's law where the scores are ranks (whole numbers that fall by one each)."""
    ranked = sorted((-s, i) for i, (_, s, kind) in enumerate(pieces) if kind == "normal")
    if not ranked or not all(float(s).is_integer() for s, _ in ranked):
        return pieces
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    score = {i: -math.log(r + 1) - total for r, (_, i) in enumerate(ranked)}
    return [(p, score.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = pieces
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.scores = [s for _, s, _ in pieces]
        self.trie = DoubleArray(normal)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        self.floor = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN
        apart = not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == "normal")
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if apart else lambda text: [text]
        self.known: dict[str, list[int]] = {}

    def best(self, word: str) -> list[int]:
        """The segmentation of the highest score; on ties the one whose last pieces start first."""
        raw = word.encode("utf-8", "surrogatepass")
        n, base, check, value, scores = len(raw), self.trie.base, self.trie.check, self.trie.value, self.scores
        top, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        top[0] = 0.0
        i = 0
        while i < n:
            first = raw[i]
            step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, state, j, single = top[i], 0, i, False
            while j < n:
                t = base[state] + raw[j] + 1
                if check[t] != state:
                    break
                state, j = t, j + 1
                if (v := value[t]) >= 0:
                    single = single or j == i + step
                    if here + scores[v] > top[j]:
                        top[j], back[j], piece[j] = here + scores[v], i, v
            if not single and here + self.floor > top[i + step]:
                top[i + step], back[i + step], piece[i + step] = here + self.floor, i, -1
            i += step
        out: list[int] = []
        while n:
            i = back[n]
            out.extend([piece[n]] if piece[n] >= 0 else [self.bytes[b] for b in reversed(raw[i:n])] if self.bytes else [self.unknown])
            n = i
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for word in self.cut(MARK + text.replace(" ", MARK)):
            ids = self.known.get(word)
            if ids is None:
                ids = self.best(word)
                if len(word) <= SHORT:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        out, pieces, of_byte = bytearray(), self.pieces, self.of_byte
        for i in ids:
            b = of_byte.get(i)
            if b is not None:
                out.append(b)
            elif pieces[i][2] != "control":
                out += pieces[i][0].encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_BUILT: dict[str, Codec] = {}


def _codec(pieces: list[tuple[str, float, str]]) -> Codec:
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()
    return _BUILT.get(key) or _BUILT.setdefault(key, Codec(pieces))


def encoded(docs: DataFrame, pieces: list[tuple[str, float, str]], *more: str) -> DataFrame:
    """doc_id, text, the columns `more`, ids array<int>, n_bytes_fallback, round_trip (decoding gives the text back, markers read as spaces).

    Columns of `more` that are called like one of these get the suffix `_in`. Repeated rows are encoded each.
    """
    docs = documents(docs, *more, made=("ids", "n_bytes_fallback", "round_trip"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for part in slices(parts):
            texts = part.column("text").to_pylist()
            ids = [codec.encode(t) for t in texts]
            same = [codec.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
            fallback = [sum(map(codec.of_byte.__contains__, i)) for i in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(fallback, pa.int64()), pa.array(same)], [*part.schema.names, "ids", "n_bytes_fallback", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return batches(docs).mapInArrow(run, f"{fields}, ids array<int>, n_bytes_fallback long, round_trip boolean")


def decoded(rows: DataFrame, pieces: list[tuple[str, float, str]]) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids decode to null."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for part in slices(parts):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if i is None else codec.decode(i) for i in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return batches(rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["ids"].cast("array<int>").alias("ids"))).mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encoded(load(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_bytes_fallback", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "round_trip")
