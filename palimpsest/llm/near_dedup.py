"""MinHash near-dedup with HyperMinHash registers.

1. Each document's set of distinct 5-word shingles is hashed to 64 bits; equal sets form one class (a grouped count), so
   copies never meet in pairs. A class has 192 registers: the smallest hash of each bucket as leading-zero count
   plus 8 mantissa bits. Buckets that a small set leaves empty are filled from further rounds of hashing, so that keys of short
   texts are as selective as those of long ones.
2. Bands of 4 registers are keys, packed without loss into one long. Two sets of similarity 0.75 miss all 48 bands with a
   chance of 1e-8. Sets of up to 7 shingles also take each shingle as a key, which is exact where bands are weakest.
3. In every key's group the members are compared with the group's smallest member. Collision-corrected Jaccard
   estimation with a margin of 4.5 standard deviations drops what cannot reach the threshold; the rest is confirmed on full sets.
4. Groups whose members are then in one component are done: a group of thousands of near copies costs a few comparisons each.
   The sets in the others are joined exactly, by prefix filtering: shingles that only one component has come first in the order, so a set
   with many of its own drops out at once, however many sets it resembles. Each is first compared with the set of fewest own shingles
   among those that share a prefix shingle; then, between what is still apart, all pairs that length and place leave possible.
   Long lists of one shingle are compared in blocks of bounded size: no link between components is lost, no task holds a whole list.

Where a grouped value is joined back to the rows of its group it is written first: both sides of the join are then plain shuffles,
and a key with a third of all rows is split by the skew-join rule.

Null texts and texts without words are empty: linked with nothing, each its own component. Rows with a null doc_id link with nothing,
have no component and are kept. Rows that share a doc_id are told apart by their sets; equal sets are one class. Classes whose first 64
bits agree (some 17 pairs among 2.5e10 texts) would be linked; they are told apart by 128 bits and size in the rows returned.
The margin of 4.5 standard deviations loses a candidate pair at the threshold with a chance of 3e-6; a pair is seldom a group's only link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import U64, Words, batches, documents, load, materialize, mix, ngrams, picked, signed, slices
from .components import components

REGISTERS, BAND, MANTISSA, ROUNDS, TINY, BLOCK, MARGIN = 192, 4, 8, 32, 7, 512, 4.5
_SALT = U64(0xA5A5B4B4C3C3D2D2)


def shingles(texts: list, k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words: the whole sequence as one."""
    w = Words(texts, lower)
    h = w.hashes()
    grams, out = ngrams(h, k), []
    for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.empty(0, U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row per set: 256 * (leading zeros + 1) + mantissa of each bucket's smallest hash; 0: the set is empty.

    A bucket that a set leaves empty takes its hash from the next of ROUNDS rounds, each of which deals the shingles anew; what
    is still empty then takes the smallest hash of all the set's shingles. So all registers of a small set tell as much as a large set's.
    """
    sizes, top = np.array([len(s) for s in sets], np.int64), np.iinfo(np.uint64).max
    low = np.full((len(sets), REGISTERS), top, U64)
    todo = np.flatnonzero(sizes)
    for turn in range(ROUNDS):
        if not len(todo):
            break
        h = np.concatenate([sets[i] for i in todo])
        h = mix(h ^ U64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) if turn else h
        place = np.repeat(np.arange(len(todo)), sizes[todo]) * REGISTERS + (((h >> U64(32)) * U64(REGISTERS)) >> U64(32)).astype(np.int64)
        now = np.full(len(todo) * REGISTERS, top, U64)
        np.minimum.at(now, place, np.maximum(mix(h ^ _SALT) >> U64(1), U64(1)))
        old = low[todo]
        low[todo] = np.where(old == top, now.reshape(-1, REGISTERS), old)
        todo = todo[(low[todo] == top).any(1)]
    for i in todo:
        at = np.flatnonzero(low[i] == top)
        each = mix(sets[i][:, None] ^ mix(_SALT + at.astype(U64))[None, :]) >> U64(1)
        low[i, at] = np.maximum(each.min(0), U64(1))
    empty = low == top
    zeros = np.minimum(63 - np.frexp(low.astype(np.float64))[1], 61).clip(0)
    mantissa = (low << (zeros.astype(U64) + U64(2))) >> U64(64 - MANTISSA)
    return np.where(empty, 0, (zeros + 1) * (1 << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)


def _classes_of(n: np.ndarray) -> np.ndarray:
    """For sets of n shingles, the chance of each leading-zero class of a register."""
    edge = 2.0 ** -np.arange(0, 40)
    return -np.diff(1 - (1 - edge[None, :]) ** np.maximum(n / REGISTERS, 1.0)[:, None], axis=1)


def _chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets of n and m shingles agree: over classes, cells of 2**-MANTISSA each."""
    return (_classes_of(n) * _classes_of(m)).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for chance collisions, and the registers they rest on."""
    filled = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1) / np.maximum(filled, 1)
    chance = _chance(n.astype(float), m.astype(float))
    return (same - chance) / (1 - chance), filled


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The estimates, and whether sizes and estimates leave a link possible."""
    sized = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    found, filled = estimate(a, b, n, m)
    return found, sized & ((found >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))) | (filled < 24))


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def with_set_ids(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows with the set_id that near_duplicates gives their text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            with np.errstate(over="ignore"):
                sig = np.array([mix(s).sum(dtype=U64) for s in shingles(part.column("text").to_pylist(), k)], U64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signed(sig))], [*part.schema.names, "set_id"])

    return batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("set_id", LongType())]))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, sig, sig2 (the set's hash of 128 bits), regs, tiny (the shingles of small sets)."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            sets = shingles(part.column("text").to_pylist(), k)
            regs = registers(sets)
            with np.errstate(over="ignore"):
                one = np.array([mix(s).sum(dtype=U64) for s in sets], U64)
                two = np.array([mix(s ^ _SALT).sum(dtype=U64) for s in sets], U64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(one)), pa.array(signed(two)), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([signed(s) if len(s) <= TINY else [] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n", "sig", "sig2", "regs", "tiny"],
            )

    return batches(docs).mapInArrow(sign, "doc_id long, n long, sig long, sig2 long, regs binary, tiny array<long>")


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = np.array([1 << (14 * i) for i in range(BAND)], np.int64)
    for part in parts:
        r = _as_registers(part.column("regs")).astype(np.int64).reshape(part.num_rows, -1, BAND)
        key = (r * shift).sum(2) + (np.arange(r.shape[1], dtype=np.int64) << 56)
        row, band = np.nonzero(r.any(2))
        vid = part.column("vid").to_numpy()
        tiny = part.column("tiny").to_pylist()
        small = [(v, t) for v, ts in zip(vid.tolist(), tiny, strict=True) for t in ts]
        keys = np.concatenate([key[row, band], np.array([t | -(1 << 63) for _, t in small], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([vid[row], np.array([v for v, _ in small], np.int64)]))], ["key", "vid"])


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may link, as their registers say."""

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = _may_link(_as_registers(part.column("ra")), _as_registers(part.column("rb")), part.column("na").to_numpy(), part.column("nb").to_numpy(), threshold)[1]
            yield part.select(["a", "b"]).filter(pa.array(ok))

    side = lambda s: classes.select(F.col("vid").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def _sets(vids: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """vid, items: the sorted hashes of these classes' sets, made again from a text of each."""
    need = materialize(vids.join(classes.select("vid", "rep"), "vid"))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = shingles(part.column("text").to_pylist(), k)
            with np.errstate(over="ignore"):
                vid = np.array([mix(s).sum(dtype=U64) for s in found], U64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(vid)), pa.array([s.tobytes() for s in found], pa.binary())], ["vid", "items"])

    items = picked(docs, need.select(F.col("rep").alias("doc_id")), "doc_id").mapInArrow(sets, "vid long, items binary")
    return materialize(items.join(need.select("vid"), "vid", "left_semi").dropDuplicates(["vid"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("vid")).union(pairs.select(F.col("b").alias("vid"))).distinct()


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= 75 * union for 75 percent."""

    def confirm(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = []
            for x, y in zip(part.column("sa"), part.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: items.select(F.col("vid").alias(s), F.col("items").alias(f"s{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(confirm, "a long, b long")


def _postings(items: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """s, vid, n, pos, comp, alone: the shingles s in the prefixes of these sets, as prefix filtering has them.

    Shingles are in one order for all sets: those that only one component has come first, since they are in no link between
    components; then by the number of sets that have them. A set of n shingles that links to another component shares one of its first
    n - ceil(percent % of n) + 1 with it. pos is the place in that order, alone the share of shingles that no other component has.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            sizes = np.array([len(x) for x in sets])
            vid, comp = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("vid", "comp"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(vid), pa.array(np.repeat(sizes, sizes)), pa.array(comp)], ["s", "vid", "n", "comp"])

    of = items.join(linked.select(F.col("u").alias("vid"), "component"), "vid", "left").select("vid", "items", F.coalesce("component", "vid").alias("comp"))
    every = batches(of).mapInArrow(rows, "s long, vid long, n long, comp long")
    shared = every.groupBy("s").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s", "df")
    shared = materialize(shared)
    own = W.partitionBy("vid")
    live = every.join(shared, "s").withColumn("live", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "s")))
    live = live.withColumn("pos", F.col("n") - F.col("live") + F.col("rank")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return materialize(live.select("s", "vid", "n", "pos", "comp", (1 - F.col("live") / F.col("n")).alias("alone")))


def _typical(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each posting with that of its shingle whose set has the smallest share of own shingles."""
    centre = postings.groupBy("s").agg(F.min(F.struct("alone", F.col("vid").alias("v"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("of"))).alias("c"))
    pairs = postings.join(materialize(centre.select("s", "c.*").drop("alone")), "s").where("comp <> of").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = pairs.where((100 + percent) * (1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))) >= percent * (F.col("n") + F.col("m")))
    return pairs.select(F.least("vid", "v").alias("a"), F.greatest("vid", "v").alias("b")).distinct()


def _crossing(percent: int):
    """Rows (cell, vid, n, pos, comp), sorted by cell: the pairs (a, b) of different components whose sizes and places leave a link possible."""

    def cell(t: pa.Table) -> pa.RecordBatch:
        vid, n, pos, comp = (t.column(c).to_numpy() for c in ("vid", "n", "pos", "comp"))
        out = [np.empty((2, 0), np.int64)]
        kinds, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(inverse != counts.argmax()) if len(kinds) > 1 else ():
            most = 1 + np.minimum(n - pos, n[i] - pos[i])
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((100 + percent) * most >= percent * (n + n[i]))
            j = np.flatnonzero(ok)
            out.append(np.sort(np.stack([np.full(len(j), vid[i]), vid[j]]), 0))
        pairs = np.unique(np.concatenate(out, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in parts:
            t = pa.Table.from_batches([part])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column("cell").to_numpy()
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, b in zip([0, *edge[:-1]], edge, strict=False):
                yield cell(held.slice(a, b - a))
            held = held.slice(edge[-1]) if len(edge) else held
        if held is not None and held.num_rows:
            yield cell(held)

    return run


def _joined(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a posting's shingle, from cells of two blocks of at most some BLOCK postings."""
    sizes = postings.groupBy("s").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    m = postings.join(materialize(sizes.select("s", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))), "s")
    m = m.withColumn("mine", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = m.select(F.xxhash64("s", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "vid", "n", "pos", "comp")
    return batches(cells.repartition("cell").sortWithinPartitions("cell"), 2000).mapInArrow(_crossing(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_id (equal sets share it), component_id (smallest doc_id that links reach, the own included), group_id.

    Components whose smallest doc_id is the same, as rows that share a doc_id can have it, differ in group_id.
    """
    docs = documents(docs)
    signed_docs = materialize(_signatures(docs, k))
    real = signed_docs.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = materialize(real.groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("tiny").alias("tiny")).withColumnRenamed("sig", "vid"))
    keys = batches(classes.select("vid", "regs", "tiny"), 2000).mapInArrow(_keys, "key long, vid long")
    groups = keys.groupBy("key").agg(F.min("vid").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = materialize(keys.join(materialize(groups.drop("size")), "key"))
    edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = members.where("vid <> centre").select(F.least("centre", "vid").alias("a"), F.greatest("centre", "vid").alias("b")).distinct()
    tried, percent = materialize(_estimated(star, classes, threshold)), round(100 * threshold)
    links = materialize(_verified(tried, _sets(_ends(tried), classes, docs, k), percent))
    linked = components(edges(links))
    members = members.join(linked.select(F.col("u").alias("vid"), "component"), "vid", "left").select("key", "vid", F.coalesce("component", "vid").alias("comp"))
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key")
    open_ = materialize(members.join(mixed, "key", "left_semi").select("vid").distinct())
    if not open_.isEmpty():
        items = _sets(open_, classes, docs, k)
        for candidates in (_typical, _joined):
            rest = materialize(candidates(_postings(items, linked, percent), percent).join(tried, ["a", "b"], "left_anti"))
            if not rest.isEmpty():
                rest = materialize(_estimated(rest, classes, threshold))
                links, tried = links.union(materialize(_verified(rest, items, percent))), tried.union(rest)
                linked = components(edges(links))
    of = classes.select("vid", "sig2", "n", "rep").join(linked.select(F.col("u").alias("vid"), "component"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = materialize(of.groupBy("component").agg(F.min("rep").alias("component_id")))
    of = of.join(least, "component").select(F.col("vid").alias("sig"), "sig2", "n", "component_id", F.col("component").alias("group_id"))
    out = signed_docs.select("doc_id", "n", "sig", "sig2").join(of, ["sig", "sig2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("sig").alias("set_id"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"), "group_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = {
    "op9_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        m AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.y, w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
}
