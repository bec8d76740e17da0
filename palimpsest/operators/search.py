"""Exact vector search in blocks: a task holds a block of queries, blocks of rows stream past it as matrix products, and the best k of each query leave it.

Neither side is broadcast or collected, and no row is copied for the queries: the work is the square of the rows, disk and memory are not. Vectors that are null, empty or hold null or non-finite
components, and rows without id, take no part; vectors of different lengths are not compared. A zero norm scores 0.
Repeated ids are rows of their own; a query never finds rows of its own id.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import script_terms
from .retrieval import contained_in
from .tables import numbered, written

#: Rows of the smallest and largest blocks; bytes of a block; scores worked out at once; rows of small groups that are compared as one matrix.
TILE_QUERIES, TILE_ROWS, BLOCK_BYTES, SCORES, TOGETHER = 1024, 8192, 4_000_000, 1 << 22, 512


def vectors(rows: DataFrame, id_col: str, vec: str, group: str | None = None) -> DataFrame:
    """id, vec (unit length, as doubles), group."""
    fine = lambda x: (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    # the norm and the vector's own expression stand outside the lambda over the components
    scaled = lambda x: F.zip_with(x, F.array_repeat(norm(x), F.size(x)), lambda c, n: F.coalesce(c / F.nullif(n, F.lit(0.0)), F.lit(0.0)))
    x = F.col(vec).cast("array<double>")
    usable, unit = _once(x, fine), _once(x, scaled)
    out = rows.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    return out.select(F.col(id_col).cast("long").alias("id"), unit.alias("vec"), (F.col(group) if group else F.lit(0)).cast("string").alias("group"))


def _allowed(rule: str, of: np.ndarray, of_group: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which rows a query may find; group -1 is no group."""
    ok = ids != of
    if rule in ("earlier", "same-earlier"):
        ok &= ids < of
    if rule in ("same", "same-earlier"):
        ok &= (groups == of_group) & (groups >= 0)
    if rule == "other":
        ok &= (groups != of_group) & (groups >= 0) & (of_group >= 0)
    return ok


class _Best:
    """The k best rows of each of some queries, whose rows come block by block. Scores are rounded only where they can still count; the work on others is one comparison."""

    def __init__(self, k: int, rule: str, places: int, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray):
        self.k, self.rule, self.places, self.of, self.vecs, self.groups = k, rule, places, ids, vecs, groups
        self.ids, self.scores = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)

    def add(self, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray) -> None:
        step = max(1, min(len(self.of), SCORES // max(1, len(ids))))
        for at in range(0, len(self.of), step):
            self._add(slice(at, at + step), ids, vecs, groups)

    def _add(self, part: slice, ids: np.ndarray, vecs: np.ndarray, groups: np.ndarray) -> None:
        of, of_group, slack = self.of[part], self.groups[part], 10.0**-self.places
        score = self.vecs[part] @ vecs.T
        least = self.scores[part, -1] - slack
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and len(ids) > self.k:  # these have fewer than k so far: what counts is at least the k-th best of this block
            some = np.where(_allowed(self.rule, of[fresh, None], of_group[fresh, None], ids[None, :], groups[None, :]), score[fresh], -np.inf)
            least[fresh] = np.partition(some, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - slack
        q, r = np.nonzero(score >= least[:, None])
        ok = _allowed(self.rule, of[q], of_group[q], ids[r], groups[r])
        q, r = q[ok], r[ok]
        if len(q):
            self._merge(part.start, q, ids[r], np.round(score[q, r], self.places) + 0.0)

    def _merge(self, start: int, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, q = np.unique(q, return_inverse=True)
        rows = rows + start
        q = np.concatenate([np.repeat(np.arange(len(rows)), self.k), q])
        ids, scores = np.concatenate([self.ids[rows].ravel(), ids]), np.concatenate([self.scores[rows].ravel(), scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.ids[rows], self.scores[rows] = ids[kept].reshape(-1, self.k), scores[kept].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i = np.nonzero(~np.isneginf(self.scores))
        return self.of[q], self.ids[q, i], self.scores[q, i]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the rows and their matrix, for each length of a batch's vectors."""
    vec = batch.column("vec")
    sizes, flat = vec.value_lengths().to_numpy(zero_copy_only=False), vec.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]] if len(at) < len(sizes) else flat.reshape(-1, d)


_BLOCK = "part int, d int, ids binary, vecs binary, names array<string>, codes binary"


def _packer(most: int, parts: int) -> Callable:
    """A function over batches (id, vec, group) that puts rows of one length into blocks: at most `most` rows or about BLOCK_BYTES each, dealt over `parts`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() * 2654435761 % parts

        def block(d: int, pieces: list) -> pa.RecordBatch:
            nonlocal made
            groups = pa.chunked_array([g for _, _, g in pieces]).combine_chunks().dictionary_encode()
            codes = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            made += 1
            row = {"part": [made % parts], "d": [d], "ids": [np.concatenate([x for x, _, _ in pieces]).tobytes()], "vecs": [np.concatenate([x for _, x, _ in pieces]).tobytes()], "names": [groups.dictionary.to_pylist()], "codes": [codes.tobytes()]}
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            ids, group = batch.column("id").to_numpy(zero_copy_only=False), batch.column("group")
            for at, vecs in _matrices(batch):
                d = vecs.shape[1]
                rows = max(1, min(most, BLOCK_BYTES // (8 * d)))
                while len(at):
                    pieces = held.setdefault(d, [])
                    room = rows - sum(len(x) for x, _, _ in pieces)
                    pieces.append((ids[at[:room]], vecs[:room], group.take(pa.array(at[:room]))))
                    if len(at) >= room:
                        yield block(d, held.pop(d))
                    at, vecs = at[room:], vecs[room:]
        for d, pieces in held.items():
            yield block(d, pieces)

    return pack


def _packed(rows: DataFrame, most: int, parts: int) -> RDD:
    """Blocks of the rows, shuffled once; what reads them again reads the shuffle's files."""
    return rows.select("id", "vec", "group").mapInArrow(_packer(most, parts), _BLOCK).repartitionById(parts, F.col("part")).rdd


def _arrays(block: Row, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and groups of a block; number has the groups' numbers, which are common to all blocks that meet."""
    ids = np.frombuffer(block["ids"], np.int64)
    names = np.array([number.setdefault(name, len(number)) for name in block["names"]] + [-1], np.int64)
    return ids, np.frombuffer(block["vecs"]).reshape(len(ids), block["d"]), names[np.frombuffer(block["codes"], np.int32)]


def _by_streams(queries: DataFrame, rows: DataFrame, k: int, rule: str, places: int) -> DataFrame:
    """Each task holds a block of queries and streams all blocks of rows past it: no row is copied for a query, a query's list leaves a task once.

    Both sides are shuffled once, as blocks (one frame on both sides: once for both). Where the queries make few blocks the rows come in several streams, a list from each.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = queries.count()
    most = max(min(TILE_QUERIES, TILE_ROWS), min(TILE_ROWS, -(-n // (3 * cores))))
    left = _packed(queries, most, max(1, -(-n // most)))
    right = left if queries is rows else _packed(rows, TILE_ROWS, 3 * cores)
    streams = max(1, min(right.getNumPartitions(), -(-2 * cores // left.getNumPartitions())))

    def whole(blocks: Iterator[Row]) -> list:
        held = list(blocks)
        return [held] if held else []

    def search(pairs: Iterator[tuple[list, Row]]) -> Iterator[tuple]:
        best, number = None, {}
        for mine, block in pairs:
            if best is None:
                best = {}
                for d in {b["d"] for b in mine}:
                    best[d] = _Best(k, rule, places, *(np.concatenate(x) for x in zip(*(_arrays(b, number) for b in mine if b["d"] == d), strict=True)))
            if block["d"] in best and (rule not in ("same", "same-earlier") or not number.keys().isdisjoint(block["names"])):
                best[block["d"]].add(*_arrays(block, number))
        for one in (best or {}).values():
            yield tuple(x.tobytes() for x in one.found())

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], t)) for c, t in (("query", np.int64), ("id", np.int64), ("score", np.float64))], names=["query", "id", "score"])

    found = left.mapPartitions(whole).cartesian(right.coalesce(streams)).mapPartitions(search)
    return rows.sparkSession.createDataFrame(found, "query binary, id binary, score binary", verifySchema=False).mapInArrow(lists, "query long, id long, score double")


def _by_groups(queries: DataFrame, rows: DataFrame, salts: DataFrame | None, k: int, rule: str, places: int) -> DataFrame:
    """Groups of at most TILE_ROWS rows, shuffled whole and each compared with itself. salts: group, n of groups of very many queries, which are dealt over n tasks, each with the group's rows."""
    side = lambda of, kind: of.select("id", "vec", "group", F.lit(kind).alias("side"), F.lit(0).alias("salt")).where("group is not null")
    if salts is not None:
        n = F.coalesce("n", F.lit(1))
        dealt = side(queries, 2).join(F.broadcast(salts), "group", "left").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int"))
        copied = side(rows, 1).join(F.broadcast(salts), "group", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
        both = dealt.drop("n").unionByName(copied.drop("n"))
    else:
        both = side(rows, 3) if queries is rows else side(queries, 2).unionByName(side(rows, 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(batch: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, sides = batch.column("id").to_numpy(zero_copy_only=False), batch.column("side").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
            cuts = [0]
            for end, after in zip(ends, [*ends[1:], ends[-1] + TOGETHER]):
                if after - cuts[-1] > TOGETHER:
                    cuts.append(end)
            for at, vecs in _matrices(batch):
                for low, high in zip(cuts, cuts[1:]):
                    mine = slice(*np.searchsorted(at, [low, high]))
                    here, x = at[mine], vecs[mine]
                    q, r = (sides[here] & 2) > 0, (sides[here] & 1) > 0
                    best = _Best(k, rule, places, ids[here][q], x[q], group[here][q])
                    best.add(ids[here][r], x[r], group[here][r])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.found()], names=["query", "id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            held = [x for x in (*held, batch) if x is not None and x.num_rows]
            if not held:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = pc.binary_join_element_wise(whole.column("group"), pc.cast(whole.column("salt"), pa.string()), "\n").dictionary_encode()
            group = key.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            done = len(group) if batch is None else int(np.count_nonzero(group != group[-1]))  # the last group may go on
            if done:
                yield from lists(whole.slice(0, done), group[:done])
            held = [whole.slice(done)]

    return both.repartition("group", "salt").sortWithinPartitions("group", "salt").mapInArrow(search, "query long, id long, score double")


def nearest(queries: DataFrame, rows: DataFrame, k: int, rule: str = "any", places: int = 6) -> DataFrame:
    """query, id, score, rank: the k rows of highest cosine (rounded to `places`), ties to the smaller id.

    queries and rows are frames as `vectors` makes them. rule: any; same or other (group; null is no group's name, and such rows take no part); earlier (only rows of a
    smaller id); same-earlier (both). For same, groups of up to TILE_ROWS rows are compared whole, larger ones in streams of blocks as for the other rules.
    """
    if rule in ("same", "same-earlier"):
        sizes = rows.groupBy("group").agg(F.count("*").alias("rows"))
        if queries is rows:
            sizes = sizes.withColumn("asked", F.col("rows"))
        else:
            sizes = sizes.join(queries.groupBy("group").agg(F.count("*").alias("asked")), "group")
        big = written(sizes.where("group is not null").where((F.col("rows") > TILE_ROWS) | (F.col("asked") > TILE_ROWS)))
        if big.isEmpty():
            found = _by_groups(queries, rows, None, k, rule, places)
        else:  # at most one name for each TILE_ROWS rows
            large = F.broadcast(big.where(F.col("rows") > TILE_ROWS).select("group"))
            part = lambda of, how: of.join(large, "group", how).select("id", "vec", "group")
            some = part(rows, "left_semi").sortWithinPartitions("group")
            asked = some if queries is rows else part(queries, "left_semi").sortWithinPartitions("group")
            salts = big.where(F.col("rows") <= TILE_ROWS).select("group", F.ceil(F.col("asked") / TILE_ROWS).cast("int").alias("n"))
            others = part(rows, "left_anti")
            found = _by_streams(asked, some, k, rule, places).union(_by_groups(others if queries is rows else part(queries, "left_anti"), others, None if queries is rows else salts, k, rule, places))
    else:
        found = _by_streams(queries, rows, k, rule, places)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def non_local_neighbours(rows: DataFrame, top: int = 2, least: float = 0.25) -> DataFrame:
    """group, a, b, score: undirected edges from each vector to its `top` nearest ones of its group, more than one place away in id order.

    rows as `vectors` makes them, ids being unique. a and b are places from 1; the threshold applies after the top. A vector has at most
    two rows beside it, so the nearest `top` + 2 hold all that count.
    """
    places = rows.select("id", "group", F.row_number().over(Window.partitionBy("group").orderBy("id")).alias("p")).where("group is not null")
    found = nearest(rows, rows, top + 2, "same", 9).select("query", "id", "score")
    found = found.join(places.select(F.col("id").alias("query"), "group", "p"), "query").join(places.select("id", F.col("p").alias("q")), "id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "q"))
    best = found.where(F.abs(F.col("p") - F.col("q")) > 1).withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("score") >= least))
    return best.groupBy("group", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("score").alias("score"))


def undirected(pairs: DataFrame, least: float) -> DataFrame:
    """a, b, score: each pair once, with its highest score, where that is at least `least`."""
    return pairs.where(F.col("score") >= least).groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("score").alias("score"))


def centroids(rows: DataFrame) -> DataFrame:
    """id, vec, group: normalised mean vectors of groups, summed by dimension with partial aggregation. id is the group as a number where all names are numbers, else a hash of the name."""
    each = rows.select("group", F.posexplode("vec").alias("d", "x")).groupBy("group", "d").agg(F.avg("x").alias("x"))
    mean = each.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    number = F.col("group").try_cast("long")
    named = mean.agg(F.count_if(F.col("group").isNotNull() & number.isNull())).first()[0]
    return vectors(mean.withColumn("id", F.xxhash64("group") if named else number), "id", "v", "group")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def hashed_bigrams(text: Column, dims: int = 128) -> Column:
    """array<float>: how many character bigrams fall into each bucket of crc32 modulo `dims`. Null and short texts: zeros. The work is linear in the text, not that times `dims`."""

    @F.pandas_udf("array<float>")
    def counted(texts: pd.Series) -> pd.Series:
        at: dict[str, int] = {}

        def buckets(t: str | None) -> np.ndarray:
            out = np.zeros(dims, np.float32)
            for pair, n in Counter(map("".join, zip(t or "", (t or "")[1:]))).items():
                if pair not in at:
                    at[pair] = zlib.crc32(pair.encode()) % dims
                out[at[pair]] += n
            return out

        return texts.map(buckets)

    return counted(text)


def scored_pairs(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (query, doc, ...) with `dense`, the cosine (6 places) of their vectors; pairs without both vectors are left out."""
    q = queries.select(F.col("id").alias("query"), F.col("vec").alias("q_vec"))
    r = rows.select(F.col("id").alias("doc"), F.col("vec").alias("d_vec"))
    dot = F.aggregate(F.zip_with("q_vec", "d_vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = pairs.join(q, "query").join(r, "doc").where(F.size("q_vec") == F.size("d_vec"))
    return both.withColumn("dense", F.round(dot, 6)).drop("q_vec", "d_vec")


def phrase_matches(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """query, doc, phrase: documents (doc, w: words) in which a phrase's words follow each other."""
    texts = docs.select("doc", F.array_join("w", " ").alias("t"))
    asked = phrases.select("query", F.col("phrase").alias("t"))
    found = contained_in(asked, texts, "query", "doc", "t", 3).select(F.col("claim").alias("query"), F.col("source").alias("doc"))
    return found.join(phrases.distinct(), "query")


def term_vectors(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, term, share: each text's term counts (`script_terms`) over its norm, one row a term."""
    counts = texts.select(F.col(id_col).alias("id"), F.explode(script_terms(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "id").select("id", "term", (F.col("n") / F.col("norm")).alias("share"))


def sparse_cosine(pairs: DataFrame, texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """a, b, cosine (6 places) of the term counts of each pair (a, b) of texts; texts without terms have cosine 0. Only the pairs' terms meet.

    Ids are unique; a pair with an unknown or null id has cosine 0, repeated pairs count once.
    """
    asked = pairs.select("a", "b").distinct()
    vectors = written(term_vectors(texts, id_col, text))
    left = asked.join(vectors.select(F.col("id").alias("a"), "term", F.col("share").alias("x")), "a")
    dots = left.join(vectors.select(F.col("id").alias("b"), "term", F.col("share").alias("y")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    met = asked.join(dots.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "dot"), F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left")
    return met.select("a", "b", F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("cosine"))


def channel_candidates(rows: DataFrame, group: str, order: str, key: str, text: str, window: int, near: int, least: float, path: Column | None = None, depth: int = 0) -> DataFrame:
    """group, target, source, structural, semantic, referenced, cosine, rank: for each row the candidates among the `window` rows before it.

    structural: at most `near` places before and, with a path, the first `depth` parts of both paths (cut at . / and \\) alike; semantic: cosine of term counts
    (`script_terms`) at least `least`; referenced: same key. Rows in none of the channels are left out. Ranked by cosine, the later source first. Rows meet by cells of
    `window` places, and terms by cell and term, so no group is held by a task and the work is rows x window. Rows without group take no part.
    """
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), r"[./\\\\]+"), lambda p: p != "") if path is not None else F.array().cast("array<string>")
    mine = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(key).alias("k"), F.col(text).alias("t"), parts.alias("path"))
    placed = numbered(mine, ["g", "o"], "p").withColumn("cell", F.floor(F.col("p") / window))
    placed = written(placed)
    terms = written(term_vectors(placed, "p", F.col("t")).join(placed.select(F.col("p").alias("id"), "g", "cell"), "id"))

    def meet(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        """Pairs of rows (p, x...) with the rows (q, y...) at most `window` places before them in the same group."""
        after = right.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1)))
        return left.join(after, ["g", "cell", *on]).where((F.col("q") < F.col("p")) & (F.col("q") >= F.col("p") - window))

    dots = meet(terms.select("g", "cell", "term", F.col("id").alias("p"), F.col("share").alias("x")), terms.select("g", "cell", "term", F.col("id").alias("q"), F.col("share").alias("y")), "term")
    dots = dots.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = meet(placed.select("g", "cell", "p", F.col("o").alias("target"), "k", "path"), placed.select("g", "cell", F.col("p").alias("q"), F.col("o").alias("source"), F.col("k").alias("k2"), F.col("path").alias("path2")))
    close = F.col("p") - F.col("q") <= near
    if path is not None and depth:
        close = close & (F.size("path") >= depth) & (F.slice("path", 1, depth) == F.slice("path2", 1, depth))
    out = pairs.join(dots, ["p", "q"], "left").withColumn("cosine", F.round(F.coalesce("dot", F.lit(0.0)), 6))
    out = out.select(F.col("g").alias(group), "target", "source", close.alias("structural"), (F.col("k") == F.col("k2")).alias("referenced"), "cosine")
    out = out.withColumn("semantic", F.col("cosine") >= least).where("structural or semantic or referenced")
    rank = F.row_number().over(Window.partitionBy(group, "target").orderBy(F.desc("cosine"), F.desc("source")))
    return out.withColumn("rank", rank)
