"""An append-only vector memory that grows with a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

_COLUMNS = "id long, text string, vec array<double>, batch long"


def observed(texts: DataFrame, id_col: str, text: str, embed: Callable[[Column], Column], path: str) -> DataStreamWriter:
    """A writer that adds the rows of each batch to the memory at `path`; the caller sets checkpoint and trigger and starts it.

    A batch has a folder of its own, which a repeated run of that batch replaces: nothing is added twice. Rows without id take no part.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        rows.withColumn("vec", embed(F.col("text")).cast("array<double>")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(add)


def memory(spark: SparkSession, path: str) -> DataFrame:
    """id, text, vec: what was observed so far; of an id observed several times the last batch counts, and in it the greatest text."""
    rows = spark.read.schema(_COLUMNS).parquet(path)
    latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch"), F.desc("text")))
    return rows.withColumn("n", latest).where("n = 1").select("id", "text", "vec")
