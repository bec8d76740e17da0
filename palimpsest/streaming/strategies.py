"""Memory strategies: what a text may draw on (`contexts`), and what is kept after it was seen (`kept`), over an ordered log.

A strategy is a pair of DataFrame functions, so the same pair answers a whole table at once and, batch by batch, a stream. The state is a snapshot: a table of the rows that are kept, one version for each
batch, from which a later run, or another application, goes on.

Logs are rows (subject, place, text): place orders a subject's texts, and an item's context holds earlier places only. A stream's batches come in order of place within each subject; rows without subject or
place take no part, null texts are empty, and a repeated (subject, place) is for the caller to settle first. An empty batch leaves the state as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import tokens
from ..operators.folds import skip_pack
from ..operators.search import nearest, vectors
from ..operators.segments import newest_as_of

_LOG = "subject long, place long, text string"


@dataclass(frozen=True)
class Strategy:
    """contexts(log, asked): rows (subject, as_of, place, used) for the asked (subject, place) of the log. kept(log): the log rows that later contexts can still draw on."""

    name: str
    contexts: Callable[[DataFrame, DataFrame], DataFrame]
    kept: Callable[[DataFrame], DataFrame]


def log_rows(rows: DataFrame, subject: str, place: str, text: str) -> DataFrame:
    usable = rows.where(F.col(subject).isNotNull() & F.col(place).isNotNull())
    return usable.select(F.col(subject).cast("long").alias("subject"), F.col(place).cast("long").alias("place"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def recency(budget: int) -> Strategy:
    """The newest whole texts before the immediate predecessor that fit the token budget; the newest is cut if it alone has more.

    Kept are a subject's last two texts, and the newest ones with tokens before them until they pass the budget: a bounded number of tokens.
    """

    def contexts(log: DataFrame, asked: DataFrame) -> DataFrame:
        packed = newest_as_of(log, "subject", "place", "text", budget).select("subject", "as_of", "place", "used")
        return packed.join(asked.select("subject", F.col("place").alias("as_of")), ["subject", "as_of"], "left_semi")

    def kept(log: DataFrame) -> DataFrame:
        after = Window.partitionBy("subject").orderBy(F.desc("place"))
        size = F.size(tokens(F.col("text")))
        newer = F.sum(F.when(F.col("_nth") > 1, size).otherwise(0)).over(after.rowsBetween(Window.unboundedPreceding, -1))
        counted = log.withColumn("_nth", F.row_number().over(after)).withColumn("_newer", F.coalesce(newer, F.lit(0)))
        return counted.where((F.col("_nth") <= 2) | ((F.col("_newer") <= budget) & (size > 0))).drop("_nth", "_newer")

    return Strategy(f"recency-{budget}", contexts, kept)


def vector(embed: Callable[[Column], Column], k: int, budget: int) -> Strategy:
    """Of a subject's k nearest earlier texts those that fit the token budget, the nearest first; one that does not fit is left out and the next is tried. All texts are kept."""

    def contexts(log: DataFrame, asked: DataFrame) -> DataFrame:
        # A vector's id packs subject and place: both have to be known in order to rank within a subject and before a place.
        numbered = log.withColumn("id", F.col("subject") * (1 << 24) + F.col("place")).withColumn("vec", embed(F.col("text")))
        rows = vectors(numbered, "id", "vec", "subject")
        mine = rows.join(asked.select((F.col("subject") * (1 << 24) + F.col("place")).alias("id")), "id", "left_semi")
        found = nearest(mine, rows, k, "same-earlier").select("query", F.col("id").alias("row"), "rank")
        sizes = numbered.select(F.col("id").alias("row"), F.size(tokens(F.col("text"))).alias("size"))
        packed = skip_pack(found.join(sizes, "row"), "query", [F.col("rank")], "row", F.col("size"), budget)
        low = lambda c: F.col(c).bitwiseAND((1 << 24) - 1)
        return packed.select(F.shiftright("query", 24).alias("subject"), low("query").alias("as_of"), low("row").alias("place"), "used")

    return Strategy(f"vector-{k}-{budget}", contexts, lambda log: log)


def _states(spark: SparkSession, path: str, strategy: Strategy) -> dict[int, str]:
    """The complete states by number of their batch. A state of another strategy raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder = at(f"{path}/state")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if others := {f.partition("@")[2] for f in found} - {strategy.name}:
        raise ValueError(f"the state below {path} is that of {', '.join(sorted(others))}, not of {strategy.name}")
    return {int(f.partition("@")[0]): f"{path}/state/{f}" for f in sorted(found) if fs.exists(at(f"{path}/state/{f}/_SUCCESS"))}


def snapshot(spark: SparkSession, path: str, strategy: Strategy, until: int | None = None) -> DataFrame:
    """The state after the last batch (or the last before `until`): what the strategy keeps. Without any batch it is empty."""
    done = [place for number, place in _states(spark, path, strategy).items() if until is None or number < until]
    return spark.read.schema(_LOG).parquet(done[-1]) if done else spark.createDataFrame([], _LOG)


def remembered(log: DataFrame, strategy: Strategy, path: str) -> DataStreamWriter:
    """A writer that answers each batch from the state before it and the batch itself, and then writes the next state; the caller sets checkpoint and trigger and starts it.

    log: subject, place, text as `log_rows` makes them. Contexts go to path/contexts/batch=N and states to path/state; a repeated run of a batch replaces both, so nothing counts twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("subject", "place", "text").persist()
        try:
            whole = snapshot(spark, path, strategy, number).union(rows)
            strategy.contexts(whole, rows).write.mode("overwrite").parquet(f"{path}/contexts/batch={number}")
            strategy.kept(whole).write.mode("overwrite").parquet(f"{path}/state/{number:012d}@{strategy.name}")
            for old in [place for n, place in _states(spark, path, strategy).items() if n < number][:-1]:  # the state before stays, for a repeated run
                gone = spark._jvm.org.apache.hadoop.fs.Path(old)
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        finally:
            rows.unpersist()

    return log.writeStream.foreachBatch(step)


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """subject, as_of, place, used: all contexts that were given so far."""
    return spark.read.schema("subject long, as_of long, place long, used long").parquet(f"{path}/contexts").select("subject", "as_of", "place", "used")
