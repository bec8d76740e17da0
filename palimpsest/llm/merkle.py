"""Merkle dataset manifest: a persistent hash tree over the rows of each source, with a version for every tampered row.

Leaves are numbered within their source by a range sort: a partition's sizes are summed into offsets, so no source passes through
one task. A tree is then built in rounds over aligned blocks of WIDTH ** LEVELS nodes: a task turns one block into a small
persistent tree, and the blocks' roots are the nodes of the next round, until each source has one, its subroot; the subroots go through the
same rounds. On the way each node gets its path, the siblings on every level up to its block's root.

A tampered leaf makes a new version of its block: only its ancestors are copied, all other nodes are shared with the original. The version goes on
upwards along the path of its block, which the rounds above have made and which is joined by (source, block): as many rows meet a path as a block
has leaves, however many a source has. The same walk without tampering gives the original root.

Null values count as `-`. Rows with a null doc_id come first in their source and are not tampered with; rows that share a doc_id are in the order of
their leaves, so equal rows are interchangeable but have places, and proofs, of their own. A null source is a source of its own. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import load, materialize

#: Children of a node; levels that a round builds in one task.
WIDTH, LEVELS = 16, 3
#: Sources and their order are shuffled like all else; this many leaves go to a partition of the range sort.
SORT_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node:
    """A node of a persistent tree. It never changes: a version shares all nodes but those on the way to its leaf."""

    __slots__ = ("children", "digest")

    def __init__(self, value: str, children: tuple[Node, ...] = ()):
        self.digest, self.children = value, children

    @staticmethod
    def over(children: tuple[Node, ...]) -> Node:
        return Node(digest(*(c.digest for c in children)), children)

    @classmethod
    def tree(cls, leaves: list[str], levels: int | None = None) -> Node:
        """The root over the leaves: after `levels` levels, or (None) as soon as one node is left."""
        row = [cls(x) for x in leaves]
        while len(row) > 1 if levels is None else levels:
            row = [cls.over(tuple(row[i : i + WIDTH])) for i in range(0, len(row), WIDTH)]
            levels = None if levels is None else levels - 1
        return row[0]

    def depth(self) -> int:
        return 1 + self.children[0].depth() if self.children else 0

    def path(self, place: int) -> list[tuple[str, str]]:
        """The siblings left and right of the way to a leaf, from the leaf's level up."""
        out, node = [], self
        for level in reversed(range(self.depth())):
            turn = place // WIDTH**level % WIDTH
            row = [c.digest for c in node.children]
            out.append(("".join(row[:turn]), "".join(row[turn + 1 :])))
            node = node.children[turn]
        return out[::-1]

    def changed(self, place: int, leaf: str) -> Node:
        """The version in which the leaf at `place` has another digest: its ancestors are copied, the rest is shared."""
        if not self.children:
            return Node(leaf)
        level = self.depth() - 1
        turn = place // WIDTH**level % WIDTH
        return Node.over((*self.children[:turn], self.children[turn].changed(place % WIDTH**level, leaf), *self.children[turn + 1 :]))


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _leaf(*values: F.Column) -> F.Column:
    """The digest of a row's values, each as `-` or its byte count, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered (null where the row is not tampered with). Other columns, whatever their names, are left out."""
    values = [docs[c].cast("long") if c in ("doc_id", "n_chars") else docs[c].cast("string") for c in FIELDS]
    lowered = F.translate(values[4], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    picked = F.crc32(values[0].cast("string").cast("binary")) % 5 == 0
    return docs.select(values[0].alias("doc_id"), values[1].alias("source"), _leaf(*values).alias("leaf"), F.when(picked, _leaf(*values[:4], lowered)).alias("tampered"))


def placed(rows: DataFrame, by: list[str], within: str | None, width: int) -> DataFrame:
    """The rows with `place`, counted from 0 in the order of `by` (nulls first) within each value of `within`, and `block` (place // width).

    Rows that are equal in `by` get places of their own in any order.
    """
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    parts = min(10_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SORT_ROWS)))
    keys = [F.col(c).asc_nulls_first() for c in [*([within] if within else []), *by, "row"]]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    tree = within or "tree"
    ordered = ordered if within else ordered.withColumn("tree", F.lit(0))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            names = batch.column(tree).to_pylist()
            at = np.empty(len(names), np.int64)
            for i, name in enumerate(names):
                seen = seen + 1 if name == last else 0
                last, at[i] = name, seen
            yield batch.append_column("at", pa.array(at))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    ordered = materialize(ordered.mapInArrow(number, f"{fields}, at long"))
    sizes = ordered.groupBy(tree, "part").count()  # sorted by tree: as many rows as partitions and trees together
    offsets = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(tree)).alias("n")
    offsets = offsets.select(F.col(tree).alias("tree_"), F.col("part").alias("part_"), "before", total)
    found = ordered.join(offsets, F.col(tree).eqNullSafe(F.col("tree_")) & (F.col("part") == F.col("part_")))
    return found.withColumn("place", F.col("before") + F.col("at")).withColumn("block", F.floor(F.col("place") / width)).drop("row", "part", "at", "tree_", "part_", "before")


_STEP = "array<struct<left:string,right:string>>"


def paths(nodes: DataFrame, tree: str) -> DataFrame:
    """tree, place, steps, root: for each node of each tree the siblings on its way and the tree's root.

    nodes: tree (null is a tree of its own), place (from 0, without gaps), n (nodes of the tree), digest.
    """
    width = WIDTH**LEVELS
    rounds, now = [], nodes.select(F.col(tree).alias("tree"), "place", "n", "digest")
    while True:

        def block(group: pa.Table) -> pa.Table:
            group = group.sort_by("place")
            one = group.column("n")[0].as_py() <= width
            root = Node.tree(group.column("digest").to_pylist(), None if one else LEVELS)
            at = group.column("place").to_pylist()
            steps = [[{"left": a, "right": b} for a, b in root.path(p % width)] for p in at]
            return pa.table({"tree": group.column("tree"), "place": group.column("place"), "n": group.column("n"), "steps": pa.array(steps, _STEPS), "root": pa.array([root.digest] * len(at))})

        made = now.withColumn("block", F.floor(F.col("place") / width)).groupBy("tree", "block").applyInArrow(block, f"tree {dict(now.dtypes)['tree']}, place long, n long, steps {_STEP}, root string")
        rounds.append(made := materialize(made))
        if made.agg(F.max("n")).first()[0] is None or made.agg(F.max("n")).first()[0] <= width:
            break
        now = made.where(F.col("place") % width == 0).select("tree", F.floor(F.col("place") / width).alias("place"), F.ceil(F.col("n") / width).alias("n"), F.col("root").alias("digest"))
    out = rounds.pop()
    while rounds:  # from the top down: a block's path is its own steps and those of its root
        low = rounds.pop().select("tree", "place", "steps", F.floor(F.col("place") / width).alias("above"))
        high = out.select(F.col("tree").alias("tree_"), F.col("place").alias("above_"), F.col("steps").alias("more"), "root")
        met = low.join(high, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("above") == F.col("above_")))
        out = met.select("tree", "place", F.concat("steps", "more").alias("steps"), "root")
    return out.select("tree", "place", "steps", "root")


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row."""
    ship(docs.sparkSession)
    width = WIDTH**LEVELS
    rows = materialize(placed(leaves(docs), ["doc_id", "leaf"], "source", width))

    def block_root(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        one = group.column("n")[0].as_py() <= width
        root = Node.tree(group.column("leaf").to_pylist(), None if one else LEVELS)
        return pa.table({"source": group.column("source").slice(0, 1), "place": group.column("block").slice(0, 1), "n": pa.array([-(-group.column("n")[0].as_py() // width)], pa.int64()), "digest": pa.array([root.digest])})

    blocks = materialize(rows.select("source", "block", "place", "n", "leaf").groupBy("source", "block").applyInArrow(block_root, "source string, place long, n long, digest string"))
    within = materialize(paths(blocks, "source"))
    subroots = placed(within.where("place = 0").select(F.col("tree").alias("source"), F.col("root").alias("digest")), ["source"], None, width)
    above = paths(subroots, "tree").join(subroots.select("place", "source"), "place").select("source", F.col("steps").alias("top"), F.col("root").alias("whole"))
    above = materialize(above)
    by_block = within.join(above, within["tree"].eqNullSafe(above["source"])).select(F.col("tree").alias("source_"), F.col("place").alias("block_"), F.col("root").alias("subroot_"), F.col("whole").alias("root_"), F.concat("steps", "top").alias("way"))
    met = rows.join(by_block, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    # One row of a block carries the block's path: the others need not repeat it in the shuffle.
    met = met.select("source", "block", "place", "n", "doc_id", "leaf", "tampered", "subroot_", "root_", F.when(F.col("place") % width == 0, F.col("way")).alias("way"))

    def versions(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        one = group.column("n")[0].as_py() <= width
        original = Node.tree(group.column("leaf").to_pylist(), None if one else LEVELS)
        way = [(s["left"], s["right"]) for s in group.column("way")[0].as_py()]
        upper = [x for step in way for x in step]
        proofs, ends, same = [], [], folded(original.digest, way)
        for place, leaf, tampered in zip(*(group.column(c).to_pylist() for c in ("place", "leaf", "tampered")), strict=True):
            proofs.append(digest(*(x for step in original.path(place % width) for x in step), *upper))
            version = original if tampered in (None, leaf) else original.changed(place % width, tampered)
            ends.append(same if version is original else folded(version.digest, way))
        root = group.column("root_")
        return pa.table({"doc_id": group.column("doc_id"), "leaf": group.column("leaf"), "subroot": group.column("subroot_"), "root": root, "proof_sha256": pa.array(proofs), "folded_root": pa.array(ends), "verified": pa.array([e == r for e, r in zip(ends, root.to_pylist(), strict=True)])})

    return met.groupBy("source", "block").applyInArrow(versions, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"))


def _sql(levels: int = 5) -> str:
    """The trees level by level, `levels` of them (16 ** levels rows of a source); a level of one node stays as it is."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}) END"
    leaf = "sha256(concat(" + ", ".join(map(field.format, FIELDS)) + "))"
    # crc32 bit by bit over the digits of doc_id: -1 stands for a shift.
    crc = "xor(list_reduce(flatten([[4294967295], flatten(list_transform(range(1, length({0}) + 1), lambda i: list_concat([ascii(substr({0}, i, 1))], [-1, -1, -1, -1, -1, -1, -1, -1])))]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    ctes = [
        f"d AS (SELECT *, {leaf} AS leaf, {crc.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS picked FROM documents)",
        f"l AS (SELECT *, CASE WHEN picked THEN {leaf.replace(field.format('text'), field.format('low'))} ELSE leaf END AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d))",
        "t0 AS (SELECT source AS g, p, leaf AS h FROM l)",
        "v0 AS (SELECT doc_id, leaf, source AS g, p, used AS f, '' AS proof FROM l)",
    ]

    def level(i: int, group: str) -> list[str]:
        siblings = f"SELECT g, p // 16 AS b, list(h ORDER BY p) AS hs FROM t{i} GROUP BY g, p // 16"
        return [
            f"c{i} AS (SELECT g, count(*) AS n FROM t{i} GROUP BY g)",
            f"s{i} AS ({siblings})",
            f"t{i + 1} AS (SELECT s.g, s.b AS p, CASE WHEN c.n = 1 THEN s.hs[1] ELSE sha256(array_to_string(s.hs, '')) END AS h FROM s{i} s JOIN c{i} c ON s.g IS NOT DISTINCT FROM c.g)",
            f"v{i + 1} AS (SELECT v.doc_id, v.leaf, v.g{group}, v.p // 16 AS p, CASE WHEN c.n = 1 THEN v.f ELSE sha256(concat(array_to_string(s.hs[1:v.p % 16], ''), v.f, array_to_string(s.hs[v.p % 16 + 2:], ''))) END AS f, CASE WHEN c.n = 1 THEN v.proof ELSE concat(v.proof, array_to_string(s.hs[1:v.p % 16], ''), array_to_string(s.hs[v.p % 16 + 2:], '')) END AS proof FROM v{i} v JOIN s{i} s ON v.g IS NOT DISTINCT FROM s.g AND v.p // 16 = s.b JOIN c{i} c ON v.g IS NOT DISTINCT FROM c.g)",
        ]

    for i in range(levels):
        ctes += level(i, "")
    k = levels + 1
    ctes += [
        f"r AS (SELECT g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS p FROM t{levels})",
        f"t{k} AS (SELECT 0 AS g, p, h FROM r)",
        f"v{k} AS (SELECT v.doc_id, v.leaf, 0 AS g, r.h AS subroot, r.p, v.f, v.proof FROM v{levels} v JOIN r ON v.g IS NOT DISTINCT FROM r.g)",
    ]
    for i in range(k, k + levels):
        ctes += level(i, ", v.subroot")
    top = k + levels
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM v{top} v CROSS JOIN t{top} t"


SQL = {"op13_merkle_manifest": _sql()}
