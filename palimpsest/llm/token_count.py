"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is cut into pieces as the vocabulary's own pre-tokenizer cuts it. In each piece the adjacent pair of lowest rank
(leftmost on ties) is merged again and again; the count is the initial symbols minus the merges. Counts of pieces are
kept in a dictionary of bounded size in each worker. The vocabulary file's content is broadcast (some MB, fixed).

Null or empty texts count 0. A special token's string inside a text counts as one token, as the library's default has it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, load, slices

#: Pieces whose counts a worker keeps; beyond it the dictionary starts anew.
CACHE = 600_000
#: The pattern by which byte-level pre-tokenizers of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Merges:
    """Pairs by rank, over integer symbols: 0 to 255 are bytes, every merge makes the next one."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        self.specials, names = specials, {s: b for b, s in enumerate(byte_symbols())}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((names[a], names[b]), (rank, names.setdefault(a + b, len(names))))
        self.known: dict[str, int] = {}

    def count(self, piece: bytes) -> int:
        n = len(piece)
        symbol, right, left = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if found := pairs.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = made, -1
            right[i] = k = right[j]
            merged += 1
            if k < n:
                left[k] = i
                if found := pairs.get((made, symbol[k])):
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            if (h := left[i]) >= 0 and (found := pairs.get((symbol[h], made))):
                heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return n - merged

    def tokens(self, text: str, pieces) -> int:
        total = 0
        for part, special in self._cut(text):
            total += special
            for piece in pieces(part):
                n = self.known.get(piece)
                if n is None:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    n = self.known[piece] = self.count(piece.encode("utf-8", "surrogatepass"))
                total += n
        return total

    def _cut(self, text: str) -> Iterator[tuple[str, int]]:
        if not any(s in text for s in self.specials):
            yield text, 0
            return
        import re

        parts = re.split("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")", text)
        for i, part in enumerate(parts):
            yield ("", 1) if i % 2 else (part, 0)


def read_vocabulary(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and special strings of a byte-level BPE file (.json); the driver reads it, the workers get its content."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    cut = found.get("pre_tokenizer") or {}
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or found.get("normalizer"):
        raise ValueError(f"{path} does not cut texts by the byte-level pattern alone: {cut}, {found.get('normalizer')}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
    return merges, [t["content"] for t in found.get("added_tokens", [])]


_BUILT: dict[str, Merges] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text, n_bytes (UTF-8), n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = regex.compile(PATTERN).findall
        key = hashlib.sha256(repr(shared.value).encode()).hexdigest()
        merges = _BUILT.get(key) or _BUILT.setdefault(key, Merges(*shared.value))
        for part in slices(parts):
            texts = part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array([merges.tokens(t, pieces) if t else 0 for t in texts], pa.int64())], ["doc_id", "text", "n_bytes", "n_tokens"])

    return batches(documents(docs)).mapInArrow(count, "doc_id long, text string, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
