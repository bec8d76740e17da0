"""Substring dedup: suffix automata of reference shards, with documents streamed through them for matching statistics.

Broadcasting automata of the whole corpus to every task would cost the corpus times its shards. Here each stretch of text
meets only the shards that can match it:

1. Each window of 13 words has an anchor: the smallest hash among its runs of RUN words. Equal windows have equal anchors.
   A grouped minimum gives every anchor's owner, the smallest doc_id that has it, and drops anchors of one document only.
2. Stretches of windows whose anchor the document owns are references; stretches owned by a smaller doc_id are streams.
   Both go to the owner's shard. The anchors of a very long owner are dealt over parts, each with stretches and a shard of its own, so
   a shard's automaton is bounded; streams of a hot shard are dealt over salts, for each of which the references are repeated.
3. A task builds the automaton of its shard and streams the rest: wherever the longest match ending at a word reaches
   13 words, these words go. That is exact on words, not on hashes.
4. A window whose anchor occurs in the owner in another context only stays unmatched. Runs of such windows go through 1 to 3 once
   more, each window now being its own anchor, so that its owner is the smallest doc_id that has the whole window.

The same plan runs at every size: texts are joined with their owners and with their spans by shuffles, never by a broadcast.

Null texts have no words. Rows with a null doc_id are neither references nor changed. Rows that share a doc_id are not smaller than each
other; equal rows are changed alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, documents, load, materialize, ngrams, signed, slices

#: Words of a run; of a shard's references; of the streams of one salt; windows of an owner's part.
RUN, SHARD_WORDS, STREAM_WORDS, PART_WINDOWS = 6, 40_000, 400_000, 30_000
MADE = ("rid", "spans", "n_words", "n_removed", "kept", "kept_sha256")
_STRETCH = "owner long, part int, reference boolean, rid long, doc_id long, start int, n int, words binary"
_FOUND = "matched boolean, rid long, doc_id long, start int, n int, words binary"


def _anchors(grams: np.ndarray, size: int, run: int) -> np.ndarray:
    """The smallest of every size - run + 1 consecutive hashes, by a min over doubling spans."""
    width, out, have = size - run + 1, grams, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _of_texts(part: pa.RecordBatch, size: int, run: int) -> tuple[Words, np.ndarray]:
    """The words, and the anchor of the window at each word (those that cross a text's end mean nothing)."""
    w = Words(part.column("text").to_pylist())
    return w, _anchors(ngrams(w.hashes(), run), size, run)


class Automaton:
    """Suffix automaton over words. Texts are separated by marks that no stream has."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.last, self.ids, self.marks = [-1], [0], 0, {}, 0

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        for w in words:
            self._extend(ids.setdefault(w, len(ids)))
        self.marks -= 1
        self._extend(self.marks)

    def _extend(self, c: int) -> None:
        nxt, link, length, p = self.next, self.link, self.len, self.last
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word, how many words up to it are found together in a reference."""
        nxt, link, length, ids = self.next, self.link, self.len, self.ids
        v = n = 0
        out = []
        for w in words:
            c = ids.get(w)
            if c is None:
                v = n = 0
            else:
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                to = nxt[v].get(c)
                if to is None:
                    v = n = 0
                else:
                    v, n = to, n + 1
            out.append(n)
        return out


def _anchor_rows(size: int, run: int):
    """Rows (key, doc_id, text) to each row's different anchors, with the parts into which its windows would be dealt."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            w, anchors = _of_texts(part, size, run)
            n = np.maximum(np.diff(w.off) - size + 1, 0)
            found = [np.unique(anchors[a : a + m]) for a, m in zip(w.off[:-1].tolist(), n.tolist(), strict=True)]
            each = [len(f) for f in found]
            columns = [pa.array(signed(np.concatenate(found)))] if found else [pa.array([], pa.int64())]
            columns += [pa.array(np.repeat(part.column(c).to_numpy(), each)) for c in ("key", "doc_id")]
            columns.append(pa.array(np.repeat(1 + n // PART_WINDOWS, each).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "doc_id", "parts"])

    return emit


def _stretches(size: int, run: int):
    """Rows (rid, doc_id, at, text, owners) to stretches: runs of windows with one owner and part."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            w, anchors = _of_texts(part, size, run)
            rows: list[tuple] = []
            ids = (part.column(c).to_pylist() for c in ("rid", "doc_id", "at"))
            for i, (rid, doc, at, owners) in enumerate(zip(*ids, part.column("owners"), strict=True)):
                a, b = int(w.off[i]), int(w.off[i + 1]) - size + 1
                known, owner, piece = (owners.values.field(k).to_numpy() for k in ("anchor", "owner", "part"))
                if b <= a or not len(known):
                    continue
                order = np.argsort(known)
                known, owner, piece = known[order], owner[order], piece[order]
                mine = signed(anchors[a:b])
                place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                found = known[place] == mine
                turn = (found[1:] != found[:-1]) | (owner[place[1:]] != owner[place[:-1]]) | (piece[place[1:]] != piece[place[:-1]])
                edge = np.concatenate(([0], np.flatnonzero(turn) + 1, [b - a]))
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if found[s]:
                        to, words = int(owner[place[s]]), w.buf[w.start[a + s] : w.end[a + e + size - 2]]
                        rows.append((to, int(piece[place[s]]), to == doc, rid, doc, at + s, e - s + size - 1, words))
            yield _batch(rows, _STRETCH_ARROW)

    return cut


_IDS = [("rid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]
_STRETCH_ARROW = pa.schema([("owner", pa.int64()), ("part", pa.int32()), ("reference", pa.bool_()), *_IDS])
_FOUND_ARROW = pa.schema([("matched", pa.bool_()), *_IDS])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(on: np.ndarray | list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(on, np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _streamed(stretches: DataFrame, size: int) -> DataFrame:
    """matched, rid, doc_id, start, n, words: covered spans of the streams, and spans of windows (matched is false) that no reference of their owner has."""
    total = stretches.where("reference").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    dealt = stretches.withColumn("shard", F.pmod(F.xxhash64("owner", "part"), F.lit(shards)))
    streamed = F.sum(F.when(~F.col("reference"), F.col("n")).otherwise(0))
    salts = dealt.groupBy("shard").agg(F.ceil(streamed / STREAM_WORDS).cast("int").alias("salts")).where("salts > 0")
    own = F.array(F.pmod(F.xxhash64("rid", "start"), F.col("salts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    dealt = dealt.join(salts, "shard").withColumn("salt", F.explode(F.when(F.col("reference"), every).otherwise(own)))
    dealt = dealt.select("shard", "salt", (~F.col("reference")).alias("stream"), "rid", "doc_id", "start", "words")
    dealt = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "stream")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, Automaton()
        for part in slices(parts, 2000):
            rows: list[tuple] = []
            for shard, salt, stream, rid, doc, start, text in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                if (shard, salt) != at:
                    at, automaton = (shard, salt), Automaton()
                words = text.split()
                if not stream:
                    automaton.add(words)
                    continue
                whole = np.array(automaton.matches(words)[size - 1 :]) >= size
                rows += [(True, rid, doc, start + a, b - a + size - 1, None) for a, b in _runs(whole)]
                rows += [(False, rid, doc, start + a, b - a + size - 1, b" ".join(words[a : b + size - 1])) for a, b in _runs(~whole)]
            yield _batch(rows, _FOUND_ARROW)

    return batches(dealt, 2000).mapInArrow(run, _FOUND)


def _searched(texts: DataFrame, size: int, run: int) -> DataFrame:
    """Steps 1 to 3 of the module over rows (rid, doc_id, at, text): text begins at word `at` of the document."""
    # Equal keys of different rows would do no harm: an anchor's owner is looked up by the anchor.
    texts = texts.withColumn("key", F.xxhash64("doc_id", "rid", "at"))
    anchors = batches(texts.select("key", "doc_id", "text")).mapInArrow(_anchor_rows(size, run), "anchor long, key long, doc_id long, parts int")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.max("parts").alias("parts"))
    # Written first: both sides of the join are then plain shuffles, and an anchor that a third of all documents have is split.
    shared = materialize(shared.where("owner < top").select("anchor", "owner", F.pmod(F.xxhash64("anchor"), F.col("parts")).cast("int").alias("part")))
    owners = anchors.select("anchor", "key").join(shared, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "owner", "part")).alias("owners"))
    with_owners = texts.join(owners, "key").select("rid", "doc_id", "at", "text", "owners")
    return materialize(_streamed(materialize(batches(with_owners).mapInArrow(_stretches(size, run), _STRETCH)), size))


def repeated_spans(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, rid, start, n: spans of words (numbered from 0) that windows cover which also start in a document of a smaller doc_id.

    docs: rid (an id for each different row of a doc_id), doc_id, text.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    first = _searched(usable.select("rid", "doc_id", F.lit(0).alias("at"), F.encode("text", "UTF-8").alias("text")), size, min(RUN, size))
    left = first.where("not matched").select("rid", "doc_id", F.col("start").alias("at"), F.col("words").alias("text"))
    second = _searched(left, size, size)
    return first.where("matched").union(second.where("matched")).select("doc_id", "rid", "start", "n")


def without_repeats(docs: DataFrame, size: int = 13, *more: str) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept (the text without the removed words, its other bytes as they were), kept_sha256, and the columns `more`.

    Columns of `more` that are called like one of these, rid or spans get the suffix `_in`.
    """
    docs = documents(docs, *more, made=MADE).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs.select("rid", "doc_id", "text"), size)
    spans = spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts = part.column("text").to_pylist()
            w = Words(texts)
            out: list[list] = [[], [], [], []]
            for i, spans in enumerate(part.column("spans").to_pylist()):
                a, b = int(w.off[i]), int(w.off[i + 1])
                start, end = w.start[a:b], w.end[a:b]
                gone = np.zeros(b - a, bool)
                for s in spans or ():
                    gone[s["start"] : s["start"] + s["n"]] = True
                raw = w.buf[w.at[i] : w.at[i + 1] - 1]
                kept, text = raw.split(), texts[i]
                if gone.any():
                    kept = [x for x, g in zip(kept, gone.tolist(), strict=True) if not g]
                    pieces, last = [], int(w.at[i])
                    for s, e in _runs(gone.tolist()):
                        pieces.append(w.buf[last : start[s]])
                        last = int(start[e]) if e < len(start) else int(w.at[i + 1]) - 1
                    pieces.append(w.buf[last : w.at[i + 1] - 1])
                    text = b"".join(pieces).decode("utf-8", "surrogatepass")
                for column, value in zip(out, (b - a, int(gone.sum()), text, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(value)
            names = [n for n in part.schema.names if n not in ("rid", "spans")]
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], [*names, *MADE[2:]])

    joined = batches(docs.join(spans, ["doc_id", "rid"], "left").drop("rid"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "spans")
    return joined.mapInArrow(keep, f"{fields}, n_words long, n_removed long, kept string, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = {
    "op10_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) > 12)),
        f AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE f.d < g.doc_id),
        k AS (SELECT w.doc_id, unnest(w.w) AS x, unnest(range(1, len(w.w) + 1)) AS i FROM w),
        t AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.i) AS s FROM k ANTI JOIN r ON k.doc_id = r.doc_id AND k.i = r.i GROUP BY k.doc_id),
        c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.s, '')) AS kept_sha256
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
