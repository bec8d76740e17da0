"""What the training-data operators share: reading, materialising, and hashing words in numpy.

Words are hashed to 64 bits for whole Arrow batches at once: a polynomial over the bytes, taken from one
prefix sum, so that no Python code runs per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

U64 = np.uint64
#: Rows of an Arrow batch: with texts of up to some 100 KB this keeps a Python worker below 100 MB.
BATCH_ROWS = 500
#: Bytes of a piece of a batch that is worked on at once.
SLICE_BYTES = 1 << 25
#: Most ids that are broadcast to pick rows before a shuffle; beyond it the rows are shuffled.
BROADCAST_IDS = 400_000
_BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_STEP = U64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = np.empty(0, U64), np.empty(0, U64)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, *more: str, made: tuple[str, ...] = ()) -> DataFrame:
    """doc_id as long and text as string, plus the named columns; others, whatever their names, are left out.

    A named column that is called like doc_id, text or a column that the operator makes (`made`) gets the suffix `_in`.
    """
    taken = {"doc_id", "text", *made}
    named = [docs[c].alias(f"{c}_in" if c.lower() in taken else c) for c in more]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *named)


def batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """The same frame; from now on the session hands Python so many rows at a time, to bound memory. Results do not rest on it: see `slices`."""
    conf = ship(df.sparkSession).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 2 * SLICE_BYTES)
    return df


def slices(parts: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows and about SLICE_BYTES bytes (one row at least), whatever the session's batch size is."""
    for part in parts:
        step = max(1, min(rows, SLICE_BYTES * part.num_rows // max(1, part.nbytes)))
        for i in range(0, part.num_rows, step):
            yield part.slice(i, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode alone a temporary one stands in for it; on a cluster that would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/palimpsest/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def picked(docs: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose `on` is in ids. ids is broadcast only if counted to be at most `most` rows."""
    ids = ids.select(on).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_semi")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, _BLOCK * 2)

        def run(base: int) -> np.ndarray:
            out = np.full(n, base, U64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS = run(_BASE), run(pow(_BASE, -1, 1 << 64))
    return _POWERS


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts (None: no words), as byte spans of one buffer.

    off[i]:off[i + 1] are the words of text i; start and end are byte places in buf; at[i] is where text i begins.
    """

    def __init__(self, texts: list, lower: bool = False):
        raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        buf = b" ".join([*raw, b""]) if raw else b" "
        self.buf = buf.lower() if lower else buf
        self.at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.at[1:])
        self.bytes = np.frombuffer(self.buf, np.uint8)
        space = ((self.bytes - np.uint8(9)) < 5) | (self.bytes == 32)
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            turn = np.concatenate(([0], turn))
        self.start, self.end = turn[0::2], turn[1::2]
        self.off = np.searchsorted(self.start, self.at)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        out, i, n = np.empty(len(self.start), U64), 0, len(self.start)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + _BLOCK)))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            power, inverse = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTES[self.bytes[lo:hi]] * power[: hi - lo], out=sums[1:])
            out[i:j] = (sums[self.end[i:j] - lo] - sums[self.start[i:j] - lo]) * inverse[self.start[i:j] - lo]
            i = j
        return mix(out)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words; those that cross a text's end are for the caller to leave out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    h = words[:m].copy()
    for i in range(1, n):
        h *= _STEP
        h += words[i : i + m]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
