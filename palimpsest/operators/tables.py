"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, as a session or a context setting; in local mode alone a temporary folder stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """The rows written as a table below the shared folder and read back: plan and lineage end there."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """The rows with their number, from 1, in the order of the columns (nulls first): by a range sort and the partitions' sizes, so no task holds all rows.

    Rows that are equal in `order` have numbers of their own in no promised order.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(written(rows).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    out = dealt.withColumn("_at", place).join(sizes.select("_part", before.alias("_before")), "_part")
    return out.withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def successors(rows: DataFrame, group: str, order: list[str], *keep: str) -> DataFrame:
    """group, and of each column to keep the value of a row (from_...) and of the next one of its group (to_...). Rows of a null group have none."""
    n = written(numbered(rows.where(F.col(group).isNotNull()).select(group, *order, *[c for c in keep if c not in (group, *order)]), [group, *order]))
    left = n.select(F.col(group), (F.col("number") + 1).alias("number"), *[F.col(c).alias(f"from_{c}") for c in keep])
    right = n.select(F.col(group).alias("_group"), "number", *[F.col(c).alias(f"to_{c}") for c in keep])
    return left.join(right, "number").where(F.col(group) == F.col("_group")).select(group, *[f"{side}_{c}" for c in keep for side in ("from", "to")])
