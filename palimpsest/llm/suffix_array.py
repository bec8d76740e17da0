"""Suffix-array dedup: bytes of passages that a document of a smaller doc_id has too are removed.

A suffix array of the whole corpus can't be built in one task, and comparing all shards with each other costs their square.
So each stretch of text is routed to the one shard that can hold its match, and shards are merged there:

1. Each window of 50 bytes has an anchor: the smallest hash among its runs of `run` bytes. Equal windows have equal anchors.
   Anchors are dealt over buckets and rows over groups; a task sends each bucket its anchors in packed, sorted lists. A bucket finds each
   anchor's owner, the smallest doc_id that has it, drops anchors of one document only, and sends each group the owners of the anchors it has.
   An anchor that more than one row of a task has is held once for the task; the groups that have it come in later lists, read one by one:
   so the documents of an anchor that very many have are never held at once.
2. Stretches of windows whose anchor the document owns are references; stretches owned by a smaller doc_id are streams.
   Both go to the owner's shard. The anchors of a very long owner are dealt over parts, and the streams of a hot shard over salts,
   for each of which the references are repeated.
3. A task builds its shard's suffix array (Larsson-Sadakane: the order by 8 bytes is refined by doubling, and only groups that
   are still tied are sorted again) and the common prefixes of neighbours (Kasai's rule). Neighbours that share less than 50 bytes begin a new
   window: so the array gives the shard's different windows in order, and the streams' windows are merged into it by binary search,
   comparing bytes, not hashes.
4. A window whose anchor occurs in its owner in another context only stays unmatched. Those windows go through 1 to 3 again with
   anchors of longer runs (RUNS), in the end of the whole window, whose owner is the smallest doc_id that has the window.

Null and empty texts have no bytes. Rows with a null doc_id are neither references nor changed. Rows that share a doc_id are not smaller
than each other; equal rows are changed alike. Texts below 50 bytes stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches, documents, load, materialize, mix, slices
from .substring_dedup import _anchors, _batch, _runs

SIZE = 50
#: Bytes of an anchor's run in each round; of a shard's references; of the streams of one salt; windows of an owner's part.
RUNS, SHARD_BYTES, STREAM_BYTES, PART_WINDOWS = (24, 50), 1 << 19, 1 << 22, 1 << 19
#: Every STEP-th window of a stream is looked up first, and matches are extended from there.
STEP = 16
#: Bytes of texts that are worked on at once: arrays of eight times as many stay in a core's cache.
BLOCK = 1 << 18
#: Bytes of texts for each bucket of anchors and group of rows (about), and bits of the fewest buckets; anchors that a task holds before it sends them on.
BUCKET_BYTES, LEAST_BITS, HELD = 1 << 21, 8, 1 << 20
#: No UTF-8 text has this byte: it ends each reference.
END = b"\xff"
MADE = ("rid", "spans", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
_IDS = [("rid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
_STRETCH_ARROW = pa.schema([("owner", pa.int64()), ("part", pa.int32()), ("reference", pa.bool_()), *_IDS])
_STRETCH = "owner long, part int, reference boolean, rid long, doc_id long, start long, n long, bytes binary"
#: Lists of anchors: the different ones of a task (with the smallest doc_id, how far the largest is from it, parts, and the group if one row has it, or -1);
#: then (`second`) those of more rows, with each row's group. Lists of a group's anchors; then (`second`) its texts.
_LISTS, _OWNED = ["bucket", "second", "anchors", "docs", "spread", "parts", "groups"], ["group", "second", "anchors", "owners", "parts"]
_LISTS_SQL = "bucket int, second boolean, anchors binary, docs binary, spread binary, parts binary, groups binary"
_OWNED_SQL = "group int, second boolean, anchors binary, owners binary, parts binary"
_FOUND_ARROW = pa.schema([("matched", pa.bool_()), *_IDS])
_FOUND = "matched boolean, rid long, doc_id long, start long, n long, bytes binary"


def eights(text: bytes, order: str = ">") -> np.ndarray:
    """The eight bytes from every place on as one integer (zeros after the end); with order ">" integers are in the order of the bytes."""
    return np.ndarray((len(text) + 1,), f"{order}u8", buffer=text + bytes(8), strides=(1,)).astype(U64)


def suffix_array(text: bytes) -> np.ndarray:
    """The starts of all suffixes in their order. text ends with END."""
    n, keys = len(text), eights(text)[:-1]
    sa = np.argsort(keys)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    keys, depth = keys[sa], 8
    while len(slots):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        rank[sa[slots]] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        tied = sa[slots]
        beyond = tied + depth
        keys = rank[tied] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        order = np.argsort(keys)
        sa[slots], keys, depth = tied[order], keys[order], 2 * depth
    return sa


def common_prefixes(text: bytes, sa: np.ndarray) -> np.ndarray:
    """For each suffix of the array the bytes that it shares with the one before it (0 for the first).

    Kasai's rule: if the bytes before both suffixes are equal, they share one byte less than the pair that starts a byte earlier. So only
    the other pairs are compared, eight bytes at a time.
    """
    n, raw, words = len(text), np.frombuffer(text, np.uint8), eights(text, "<")
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (raw[before[1:] - 1] == raw[:-1])
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(~follows & (before >= 0))
    while len(at):
        a, b = at + shared[at], before[at] + shared[at]
        inside = np.maximum(a, b) < n
        at, a, b = at[inside], a[inside], b[inside]
        unlike = words[a] ^ words[b]
        whole = unlike == 0
        shared[at] += np.where(whole, 8, np.bitwise_count((unlike & -unlike) - U64(1)) // 8)
        at = at[whole]
    shared = np.minimum(shared, n - np.maximum(np.arange(n), before))
    origin = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return (shared[origin] - (np.arange(n) - origin))[sa]


class Shard:
    """The different windows of some reference texts, in order."""

    def __init__(self, references: list[bytes], size: int):
        self.text = END.join([*references, b""])
        sa = suffix_array(self.text)
        new = common_prefixes(self.text, sa) < size
        ends = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 255)
        room = ends[np.searchsorted(ends, sa)] - sa
        self.at = sa[new & (room >= size)]
        self.words, self.raw = eights(self.text), np.frombuffer(self.text, np.uint8)
        self.size, self.offsets = size, [*range(0, size - 8, 8), size - 8]
        self.heads = self.words[self.at]
        turn = np.flatnonzero(np.concatenate((self.heads[1:] != self.heads[:-1], [True]))) + 1 if len(self.at) else np.empty(0, np.int64)
        self.until = np.repeat(turn, np.diff(np.concatenate(([0], turn)))) if len(self.at) else turn

    def find(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the windows that begin at `at` of a stream begin in the references; -1 if nowhere. words: the stream's `eights`."""
        out = np.full(len(at), -1)
        if not len(self.at):
            return out
        low = np.minimum(np.searchsorted(self.heads, words[at]), len(self.at) - 1)
        todo = np.flatnonzero(self.heads[low] == words[at])
        low = low[todo]
        high = self.until[low]
        while len(todo):
            middle = (low + high) // 2
            less, equal = np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for offset in self.offsets[1:]:
                have, want = self.words[self.at[middle] + offset], words[at[todo] + offset]
                less |= equal & (have < want)
                equal &= have == want
            out[todo[equal]] = self.at[middle[equal]]
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            more = ~equal & (low < high)
            todo, low, high = todo[more], low[more], high[more]
        return out

    def covered(self, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The streams' starts in one buffer, and for each place of it whether a window begins there that a reference has."""
        text = END.join([*streams, b""])
        words, raw, size = eights(text), np.frombuffer(text, np.uint8), self.size
        starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
        room = np.repeat(starts[1:], np.diff(starts)) - 1 - np.arange(len(text))
        windows = room >= size
        hit = np.zeros(len(text), bool)
        own = np.arange(len(text)) - np.repeat(starts[:-1], np.diff(starts))
        seed = np.flatnonzero(windows & ((own % STEP == 0) | (room == size)))
        found = self.find(words, seed)
        seed, found = seed[found >= 0], found[found >= 0]
        hit[seed] = True
        for side, edge in ((1, size - 1), (-1, 0)):  # the windows up to the next seed follow from the bytes on the same diagonal
            a, b = seed, found
            for t in range(1, STEP):
                here, there = a + edge + side * t, b + edge + side * t
                good = (here >= 0) & (there >= 0) & (here < len(text)) & (there < len(self.text))
                good[good] = (raw[here[good]] == self.raw[there[good]]) & (raw[here[good]] != 255)
                a, b = a[good], b[good]
                hit[a + side * t] = True
        rest = np.flatnonzero(windows & ~hit)
        hit[rest[self.find(words, rest) >= 0]] = True
        return starts, hit


def _blocks(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """The texts in blocks of about BLOCK bytes: numbers, places and bytes. A longer text is cut into pieces that share size - 1 bytes with the next, so each window is in one."""
    block: tuple[list, list, list] = ([], [], [])
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - size + 1), BLOCK):
            piece = text[at : at + BLOCK + size - 1]
            for part, value in zip(block, (i, at, piece), strict=True):
                part.append(value)
            held += len(piece)
            if held >= BLOCK:
                yield block
                block, held = ([], [], []), 0
    if block[0]:
        yield block


def _window_anchors(pieces: list[bytes], size: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of all windows of the pieces, one piece after the other, and how many windows each piece has."""
    each = np.array([len(p) for p in pieces], np.int64)
    n = np.maximum(each - size + 1, 0)
    if not n.any():
        return np.empty(0, U64), n
    words = eights(b"".join(pieces), "<")
    grams = words[: len(words) - run].copy()
    for offset in (*range(8, run - 8, 8), run - 8)[: (run - 1) // 8]:
        grams *= U64(0xD6E8FEB86659FD93)
        grams += words[offset : offset + len(grams)]
    anchors = _anchors(mix(grams), size, run)
    room = np.repeat(np.cumsum(each), each)[: len(anchors)] - np.arange(len(anchors))
    return anchors[room >= size], n


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _packed(values: np.ndarray | None, edges: np.ndarray, n: int) -> pa.Array:
    """n binary values: the bytes of values[edges[i]:edges[i + 1]], or nulls without values."""
    if values is None:
        return pa.nulls(n, pa.binary())
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _lists(number: np.ndarray, second: bool, names: list[str], **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each different number (they ascend), with its part of each column. names: those of the number, `second` and all columns."""
    edges = np.append(_turns(number), len(number))
    n = len(edges) - 1
    return pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]], pa.int32()), pa.array(np.full(n, second)), *[_packed(columns.get(c), edges, n) for c in names[2:]]], names)


def _bucket(anchors: np.ndarray, bits: int) -> np.ndarray:
    return ((anchors >> U64(1)) >> U64(63 - bits)).astype(np.int32)


def _equal(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the different values begin, and how often each occurs."""
    first = _turns(ordered)
    return first, np.diff(np.append(first, len(ordered)))


def _least(first: np.ndarray, anchors: np.ndarray, docs: np.ndarray, top: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different anchors, each with its smallest and largest doc_id and most parts."""
    return anchors[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(top, first), np.maximum.reduceat(parts, first)


def _anchor_lists(size: int, run: int, bits: int):
    """Rows (group, doc_id, text) to lists of their anchors for 1 << bits buckets, with the parts into which a row's windows would be dealt."""

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchors, docs, parts, groups = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(anchors)
        anchors, docs, parts, groups = anchors[order], docs[order], parts[order], groups[order]
        first, each = _equal(anchors)
        known, low, top, parts = _least(first, anchors, docs, docs, parts)
        yield _lists(_bucket(known, bits), False, _LISTS, anchors=known, docs=low, spread=top - low, parts=parts, groups=np.where(each == 1, groups[first], np.int32(-1)))
        many = np.repeat(each > 1, each)
        if many.any():
            anchors = anchors[many]
            yield _lists(_bucket(anchors, bits), True, _LISTS, anchors=anchors, groups=groups[many])

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        for part in slices(parts):
            texts = part.column("text").to_pylist()
            dealt = (1 + np.array([len(t) for t in texts], np.int64) // PART_WINDOWS).astype(np.int32)
            docs, groups = (part.column(c).to_numpy() for c in ("doc_id", "group"))
            for numbers, _, pieces in _blocks(texts, size):
                anchors, n = _window_anchors(pieces, size, run)
                if not len(anchors):
                    continue
                row = np.repeat(np.array(numbers), n)
                new = _turns(anchors, row)
                row = row[new]
                held.append((_spread(anchors[new]), docs[row], dealt[row], groups[row]))
                n_held += len(row)
                if n_held >= HELD:
                    yield from sent(held)
                    held, n_held = [], 0
        if held:
            yield from sent(held)

    return emit


def _spread(anchors: np.ndarray) -> np.ndarray:
    """A bijection: anchors are minima, so their high bits are mostly zeros; these are not."""
    return anchors * U64(0x9E3779B97F4A7C15)


def _owned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of anchors, in the order of bucket and `second`, to lists of each group's anchors that different documents have."""

    def resolved(lists: list[tuple]) -> tuple[tuple, tuple]:
        """Of a bucket's anchors that different documents have: anchor, owner, part; and group, anchor, owner, part of those that came with a group."""
        columns = [np.concatenate(c) for c in zip(*lists, strict=True)]
        order = np.argsort(columns[0])
        anchors, low, top, dealt, groups = (c[order] for c in columns)
        first, each = _equal(anchors)
        known, owner, top, dealt = _least(first, anchors, low, top, dealt)
        shared = owner < top
        piece = (mix(known) % dealt.astype(U64)).astype(np.int32)
        alone = np.repeat(shared, each) & (groups >= 0)
        place = np.repeat(np.arange(len(known)), each)[alone]
        return (known[shared], owner[shared], piece[shared]), (groups[alone], known[place], owner[place], piece[place])

    def sent(held: list[tuple]) -> pa.RecordBatch:
        groups, anchors, owners, pieces = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((anchors, groups))
        order = order[_turns(groups[order], anchors[order])]
        return _lists(groups[order], False, _OWNED, anchors=anchors[order], owners=owners[order], parts=pieces[order])

    at, lists, known, held, n_held = None, [], None, [], 0
    for part in slices(parts, 2000):
        for bucket, second, anchors, docs, spread, dealt, groups in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
            if lists and (bucket != at or second):
                known, found = resolved(lists)
                held.append(found)
                n_held += len(found[0])
                lists = []
            at, anchors, groups = bucket, np.frombuffer(anchors, U64), np.frombuffer(groups, np.int32)
            if not second:
                low = np.frombuffer(docs, np.int64)
                lists.append((anchors, low, low + np.frombuffer(spread, np.int64), np.frombuffer(dealt, np.int32), groups))
            elif len(known[0]):
                place = np.minimum(np.searchsorted(known[0], anchors), len(known[0]) - 1)
                found = np.flatnonzero(known[0][place] == anchors)
                place = place[found]
                held.append((groups[found], anchors[found], known[1][place], known[2][place]))
                n_held += len(found)
            if n_held >= HELD:
                yield sent(held)
                held, n_held = [], 0
    if lists:
        held.append(resolved(lists)[1])
        n_held += len(held[-1][0])
    if n_held:
        yield sent(held)


def _stretches(size: int, run: int):
    """Rows (group, second, anchors, owners, parts, rid, doc_id, at, text), of each group the anchors first, then its texts, to stretches: runs of windows with one owner and part."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_group, lists, known, owner, piece = None, [], np.empty(0, U64), None, None
        for part in slices(parts, 2000):
            group, second = part.column("group").to_numpy(), part.column("second").to_numpy(zero_copy_only=False)
            edges = [*_turns(group, second).tolist(), len(group)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = part.slice(a, b - a)
                if group[a] != at_group:
                    at_group, lists, known = group[a], [], np.empty(0, U64)
                if not second[a]:
                    lists += zip(*(rows.column(c).to_pylist() for c in ("anchors", "owners", "parts")), strict=True)
                    continue
                if lists:
                    known, owner, piece = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*lists, strict=True), (U64, np.int64, np.int32), strict=True))
                    order = np.argsort(known)  # an anchor has the same owner in all lists
                    known, owner, piece = known[order], owner[order], piece[order]
                    lists = []
                if len(known):
                    yield from of_texts(rows, known, owner, piece)

    def of_texts(part: pa.RecordBatch, known: np.ndarray, owner: np.ndarray, piece: np.ndarray) -> Iterator[pa.RecordBatch]:
        rid, doc, at, texts = (part.column(c).to_pylist() for c in ("rid", "doc_id", "at", "text"))
        for numbers, places, pieces in _blocks(texts, size):
            anchors, n = _window_anchors(pieces, size, run)
            if not len(anchors):
                continue
            row = np.repeat(np.arange(len(n)), n)
            start = _turns(anchors, row)
            mine, row = _spread(anchors[start]), row[start]
            where = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            found = known[where] == mine
            to, which = np.where(found, owner[where], 0), np.where(found, piece[where], 0)
            turn = _turns(row, found, to, which)
            end = np.append(start[turn[1:]], len(anchors))
            here = found[turn]
            turn, end = turn[here], end[here]
            start, row = start[turn], row[turn]
            within = start - (np.cumsum(n) - n)[row]
            rows: list[tuple] = []
            for r, s, long, o, w in zip(*(x.tolist() for x in (row, within, end - start + size - 1, to[turn], which[turn])), strict=True):
                i = numbers[r]
                rows.append((o, w, o == doc[i], rid[i], doc[i], at[i] + places[r] + s, long, pieces[r][s : s + long]))
            yield _batch(rows, _STRETCH_ARROW)

    return cut


def _streamed(stretches: DataFrame, size: int) -> DataFrame:
    """matched, rid, doc_id, start, n, bytes: covered spans of the streams, and spans of windows (matched is false) that no reference of their owner has."""
    total = stretches.where("reference").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    dealt = stretches.withColumn("shard", F.pmod(F.xxhash64("owner", "part"), F.lit(shards)))
    streamed = F.sum(F.when(~F.col("reference"), F.col("n")).otherwise(0))
    salts = dealt.groupBy("shard").agg(F.ceil(streamed / STREAM_BYTES).cast("int").alias("salts")).where("salts > 0")
    own = F.array(F.pmod(F.xxhash64("rid", "start"), F.col("salts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    dealt = dealt.join(salts, "shard").withColumn("salt", F.explode(F.when(F.col("reference"), every).otherwise(own)))
    dealt = dealt.select("shard", "salt", (~F.col("reference")).alias("stream"), "rid", "doc_id", "start", "bytes")
    dealt = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "stream")

    def merged(shard: Shard, streams: list[tuple]) -> pa.RecordBatch:
        rows: list[tuple] = []
        starts, hit = shard.covered([s[3] for s in streams])
        for (rid, doc, start, text), begin in zip(streams, starts.tolist(), strict=False):
            whole = hit[begin : begin + len(text) - size + 1]
            rows += [(True, rid, doc, start + a, b - a + size - 1, None) for a, b in _runs(whole)]
            rows += [(False, rid, doc, start + a, b - a + size - 1, text[a : b + size - 1]) for a, b in _runs(~whole)]
        return _batch(rows, _FOUND_ARROW)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, references, streams, held = None, None, [], [], 0
        for part in slices(parts, 2000):
            for number, salt, stream, *row in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                if (number, salt) != at or held > STREAM_BYTES:
                    if streams:
                        shard = shard or Shard(references, size)
                        yield merged(shard, streams)
                    streams, held = [], 0
                    if (number, salt) != at:
                        at, shard, references = (number, salt), None, []
                if stream:
                    streams.append(tuple(row))
                    held += len(row[3])
                else:
                    references.append(row[3])
        if streams:
            yield merged(shard or Shard(references, size), streams)

    return batches(dealt, 2000).mapInArrow(run, _FOUND)


def _searched(texts: DataFrame, size: int, run: int) -> DataFrame:
    """Steps 1 to 3 of the module over rows (rid, doc_id, at, text): text begins at byte `at` of the document."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (int(total) // BUCKET_BYTES).bit_length())
    texts = texts.withColumn("group", F.pmod(F.xxhash64("doc_id", "rid", "at"), F.lit(1 << bits)).cast("int"))
    lists = batches(texts.select("group", "doc_id", "text")).mapInArrow(_anchor_lists(size, run, bits), _LISTS_SQL)
    owned = lists.repartition("bucket").sortWithinPartitions("bucket", "second").mapInArrow(_owned, _OWNED_SQL)
    both = owned.unionByName(texts.withColumn("second", F.lit(True)), allowMissingColumns=True)
    cut = both.repartition("group").sortWithinPartitions("group", "second").mapInArrow(_stretches(size, run), _STRETCH)
    return materialize(_streamed(materialize(cut), size))


def repeated_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, rid, start, n: spans of bytes (numbered from 0) that strings of `size` bytes (9 at least) cover which also start in a document of a smaller doc_id.

    docs: rid (an id for each different row of a doc_id), doc_id, text.
    """
    left = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("rid", "doc_id", F.lit(0).cast("long").alias("at"), F.encode("text", "UTF-8").alias("text"))
    spans = None
    for run in sorted({max(8, min(r, size)) for r in RUNS} | {size}):
        found = _searched(left, size, run)
        whole = found.where("matched").select("doc_id", "rid", "start", "n")
        spans = whole if spans is None else spans.union(whole)
        left = found.where("not matched").select("rid", "doc_id", F.col("start").alias("at"), F.col("bytes").alias("text"))
    return spans


def without_repeats(docs: DataFrame, size: int = SIZE, *more: str) -> DataFrame:
    """doc_id, text, n_bytes, n_removed, n_spans, kept (the other bytes), kept_sha256, and the columns `more`.

    Bytes of a character that is cut through stay, so kept is binary. Columns of `more` that are called like one of these, rid or spans get the suffix `_in`.
    """
    docs = documents(docs, *more, made=MADE).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_bytes(docs.select("rid", "doc_id", "text"), size)
    spans = spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for a, b in sorted((s["start"], s["start"] + s["n"]) for s in found or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                ends = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            names = [n for n in part.schema.names if n not in ("rid", "spans")]
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], [*names, *MADE[2:]])

    joined = batches(docs.join(spans, ["doc_id", "rid"], "left").drop("rid"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "spans")
    return joined.mapInArrow(keep, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = {
    "op11_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + 98 <= length(h) THEN md5(substr(h, 2 * i - 1, 100)) END AS w
            FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)),
        o AS (SELECT w, min(doc_id) AS o FROM p WHERE w IS NOT NULL GROUP BY w),
        s AS (SELECT p.doc_id, p.i, p.b, max(CASE WHEN o.o < p.doc_id THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last FROM p LEFT JOIN o ON p.w = o.w),
        g AS (SELECT doc_id, i, b, coalesce(i - last < 50, false) AS gone FROM s),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g),
        k AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (starts) AS m, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.m, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)"""
}
