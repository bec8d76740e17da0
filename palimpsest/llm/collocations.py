"""Collocations by set-oriented mining: occurrence relations, grown by one word a round.

R(k) holds the occurrences of frequent phrases of k words: a place and the phrase that begins there, sorted by place. Places of one piece follow each other
and a gap parts the pieces. The relation is kept in chunks of some CHUNK words of one language, one row each, written to the shared folder in every round:

1. group-count: a chunk's different phrases with their counts meet by phrase and are summed over all chunks; those below `least` go.
2. semi-join: the frequent phrases' ids go back to the chunks that have them, once for each chunk and phrase, and R(k) keeps their occurrences.
3. extend: two occurrences of R(k) at adjacent places are one of a phrase of k + 1 words (a merge join of R(k) with itself by piece and place).

What is shuffled is one row for each chunk and phrase, so the most common phrase of a language meets as many rows as there are chunks. Words and ids are
compared, not hashes, and scores are exact decimals of 38 digits.

Null texts have no words; a null language counts as `und`. Repeated rows count each time; doc_id is not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, load, materialize, slices

#: Words of a chunk; phrases that one task ranks; bits of a phrase's number in its chunk, and of a chunk's in its partition.
CHUNK, RANKED, NUMBER_BITS, CHUNK_BITS = 1 << 19, 16_000, 26, 16
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_FIRST = "chunk long, lang string, n long, occurs binary, words array<string>, counts array<int>"
_NEXT = "chunk long, lang string, occurs binary, lefts array<long>, rights array<long>, counts array<int>"


class Words(dict):
    """Numbers from 1 for words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class Chunk:
    """The words of some texts of one language. Place 0 and the places between pieces are empty (0)."""

    def __init__(self):
        self.words, self.parts, self.n, self.size = Words(), [np.zeros(1, np.int32)], 0, 1

    def add(self, text: bytes) -> None:
        number, ids = self.words.__getitem__, []
        for piece in text.lower().translate(_CUT).split(b"\n"):
            ids += map(number, piece.split())
            ids.append(0)
            self.n -= 1
        self.n += len(ids)
        self.size += len(ids)
        self.parts.append(np.array(ids, np.int32))

    def row(self, chunk: int, lang: str) -> tuple:
        occurs = np.concatenate(self.parts)
        return chunk, lang, self.n, occurs.tobytes(), list(self.words), np.bincount(occurs, minlength=len(self.words) + 1)[1:].tolist()


def _of_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to the first relation."""
    held: dict[str, Chunk] = {}
    made = TaskContext.get().partitionId() << CHUNK_BITS

    def out(langs: list[str]) -> pa.RecordBatch:
        nonlocal made
        rows = [held.pop(lang).row(made + i, lang) for i, lang in enumerate(langs)]
        made += len(rows)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        columns[4] = columns[4].cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "n", "occurs", "words", "counts"])

    for part in slices(parts):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            chunk = held.setdefault(lang, Chunk())
            chunk.add(text.encode())
            if chunk.size >= CHUNK:
                yield out([lang])
        if sum(c.size for c in held.values()) >= 4 * CHUNK:
            yield out(list(held))
    if held:
        yield out(list(held))


def _extended(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, lang, occurs, known) of R(k), known: the frequent phrases' numbers in the chunk and their ids, to rows of R(k + 1) before its count."""
    for part in slices(parts, 1):
        occurs = np.frombuffer(part.column("occurs")[0].as_py(), np.int32)
        known = part.column("known")[0].values
        ids = np.zeros(int(occurs.max(initial=0)) + 1, np.int64)
        ids[known.field("number").to_numpy()] = known.field("id").to_numpy()
        places = np.flatnonzero(ids[occurs])
        places = places[:-1][places[1:] == places[:-1] + 1]
        pairs, which, counts = np.unique(occurs[places].astype(np.int64) * len(ids) + occurs[places + 1], return_inverse=True, return_counts=True)
        grown = np.zeros(len(occurs), np.int32)
        grown[places] = which + 1
        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((ids[pairs // len(ids)], pa.int64()), (ids[pairs % len(ids)], pa.int64()), (counts.astype(np.int32), pa.int32()))]
        yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("lang"), pa.array([grown.tobytes()]), *lists], ["chunk", "lang", "occurs", "lefts", "rights", "counts"])


def _counted(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """chunk, number, f, id of each chunk's phrases that have at least `least` occurrences in all chunks; keys only where the row is its phrase's first one (`first`).

    rows: keys, chunk, number, count. One shuffle by phrase gives count and id: the first of the phrase's (chunk, number), which no other phrase has.
    """
    code = F.shiftleft("chunk", NUMBER_BITS) + F.col("number")
    phrase = Window.partitionBy(*keys)
    found = rows.withColumns({"f": F.sum("count").over(phrase), "id": F.min(code).over(phrase)}).where(F.col("f") >= least)
    first = code == F.col("id")
    return materialize(found.select("chunk", "number", "id", first.alias("first"), F.when(first, F.col("f")).alias("f"), *[F.when(first, F.col(k)).alias(k) for k in keys]))


def _semi_joined(relation: DataFrame, counted: DataFrame) -> DataFrame:
    """chunk, lang, occurs, known."""
    known = counted.groupBy("chunk").agg(F.collect_list(F.struct("number", "id")).alias("known"))
    return batches(relation.select("chunk", "lang", "occurs").join(known, "chunk"), 2)


def phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 to `longest`: id, lang, phrase, tail (its last word), f, prefixes and suffixes (the counts of its first and last 1, 2, ... words),
    for phrases from two words on also left and right (the ids of its first and last words but one). And lang, n: all word occurrences."""
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    relation = materialize(batches(texts).mapInArrow(_of_words, _FIRST))
    n = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = relation.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("chunk", "lang", (F.col("pos") + 1).alias("number"), F.col("col.words").alias("word"), F.col("col.counts").alias("count"))
    counted = _counted(rows, ["lang", "word"], least)
    found = [counted.where("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    for _ in range(1, longest):
        relation = materialize(_semi_joined(relation, counted).mapInArrow(_extended, _NEXT))
        rows = relation.select("chunk", F.posexplode(F.arrays_zip("lefts", "rights", "counts"))).select("chunk", (F.col("pos") + 1).alias("number"), F.col("col.lefts").alias("left"), F.col("col.rights").alias("right"), F.col("col.counts").alias("count"))
        counted = _counted(rows, ["left", "right"], least)
        first = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("prefixes").alias("before"))
        last = found[-1].select(F.col("id").alias("right"), "tail", F.col("suffixes").alias("after"))
        whole = counted.where("first").join(first, "left").join(last, "right")
        found.append(materialize(whole.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "f", F.concat("before", F.array("f")).alias("prefixes"), F.concat("after", F.array("f")).alias("suffixes"), "left", "right")))
    return found, n


_SCORE = "cast(1000000 as decimal(7,0)) * (cast(f as decimal(19,0)) * cast(f as decimal(19,0))) div (cast(prefixes[k - 1] as decimal(19,0)) * cast(suffixes[size(suffixes) - k - 1] as decimal(19,0)))"
_CUTS = f"array_min(transform(sequence(1, size(prefixes) - 1), k -> struct({_SCORE} as score, k as k, prefixes[k - 1] as l, suffixes[size(suffixes) - k - 1] as r)))"


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words.

    A candidate goes if a longer one that holds it has at least `share` percent of its occurrences. It is enough to look at those of one word more: each longer
    one holds one of them, and no less often.
    """
    found, n = phrases(docs, longest, least)
    scored = None
    for i in range(1, longest):
        now = found[i].withColumn("cut", F.expr(_CUTS))
        if i + 1 < longest:
            longer = found[i + 1]
            around = longer.select(F.col("left").alias("id"), F.col("f").alias("around")).union(longer.select(F.col("right").alias("id"), F.col("f").alias("around"))).groupBy("id").agg(F.max("around").alias("around"))
            now = now.join(around, "id", "left").where(F.coalesce(100 * F.col("around") < share * F.col("f"), F.lit(True)))
        now = now.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        scored = now if scored is None else scored.union(now)
    if scored is None:
        raise ValueError("longest must be at least 2")
    scored = materialize(scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = max(1, -(-scored.count() // RANKED))
    ranked = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    while True:  # the first rows of eight salts meet in one: no task ranks a whole language
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        if salts == 1:
            break
        salts, ranked = -(-salts // 8), ranked.withColumn("salt", F.floor(F.col("salt") / 8))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


SQL = {
    "op12_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (VALUES (1), (2), (3)) v(k))),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        x AS (SELECT lang, phrase, a, w, k, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        s AS (SELECT x.lang, x.phrase, x.k, x.a, x.j, h.f AS l, t.f AS r, CAST(CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
            FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.rest),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        u AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY lang, phrase),
        y AS (SELECT b.* FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE b.k = 3 OR u.a IS NULL OR 100 * u.a < 50 * b.a),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
        SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n ON n.lang = z.lang WHERE z.rank <= 2000"""
}
