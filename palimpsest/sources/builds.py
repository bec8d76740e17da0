"""A table built in batches that can be stopped and resumed: each batch is written, then committed by a record of its id range, rows and digest.

Below `path`: plan (the id ranges, written once, with a digest of what was asked for), rows/batch=N (the built rows), commits/batch=N (the record, written after the rows; it counts once it is
complete). A batch without a complete commit is written again as a whole; committed ones are never touched. Progress is contiguous: batch N is only built after N - 1, and
`finalised` refuses gaps, changed rows and a plan that does not fit. All reads and writes go through Spark, so `path` can be in any store that it knows.

Rows without id take no part; rows of equal ids are in one batch. An empty table has a plan without batches and is finalised as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import digest

_PLAN = "batch int, first long, last long, n long, spec string"
_COMMIT = "batch int, first long, last long, n_rows long, content_sha256 string"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder that Spark wrote is there and complete."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def planned(rows: DataFrame, id_col: str, path: str, batch_rows: int, spec: str = "") -> DataFrame:
    """batch, first, last, n, spec: the batches' id ranges, of about `batch_rows` rows each. A plan that is there already is used if it has the same spec.

    The ranges are cut at quantiles, so ids need be neither dense nor even. A batch reads the table with a filter on its range: a table that is sorted by id then gives the range's row groups alone. spec names what is built: a plan with another one raises.
    """
    spark = rows.sparkSession
    if not _exists(spark, f"{path}/plan"):
        ids = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
        n = ids.count()
        parts = -(-n // batch_rows)
        cuts = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
        edges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="as_double", outputCol="raw")
        numbered = edges.transform(ids.withColumn("as_double", F.col("id").cast("double"))) if cuts else ids.withColumn("raw", F.lit(0.0))
        ranges = numbered.groupBy("raw").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).collect()  # one row a batch
        found = [(i, r["first"], r["last"], r["n"], spec) for i, r in enumerate(sorted(ranges, key=lambda r: r["raw"]))]
        spark.createDataFrame(found, _PLAN).coalesce(1).write.mode("overwrite").parquet(f"{path}/plan")
    plan = spark.read.schema(_PLAN).parquet(f"{path}/plan")
    if plan.where(~F.col("spec").eqNullSafe(F.lit(spec))).count():
        raise ValueError(f"{path} was planned for something else")
    return plan


def commits(spark: SparkSession, path: str, n: int) -> list:
    """The records of the first batches that are committed, up to the first gap."""
    done = []
    for i in range(n):
        if not _exists(spark, f"{path}/commits/batch={i}"):
            break
        done.append(i)
    if not done:
        return []
    rows = spark.read.schema(_COMMIT).parquet(*[f"{path}/commits/batch={i}" for i in done]).orderBy("batch").collect()
    if [r["batch"] for r in rows] != done or any(b["first"] <= a["last"] for a, b in zip(rows[:-1], rows[1:], strict=True)):
        raise ValueError(f"the commits below {path} do not follow each other")
    return rows


def built(rows: DataFrame, id_col: str, path: str, build: Callable[[DataFrame], DataFrame], batch_rows: int, spec: str = "", most: int | None = None) -> int:
    """Builds what is missing, at most `most` batches of it, and says how many batches are committed now."""
    spark = rows.sparkSession
    plan = planned(rows, id_col, path, batch_rows, spec).orderBy("batch").collect()
    done = len(commits(spark, path, len(plan)))
    for r in plan[done : len(plan) if most is None else done + most]:
        part = rows.where(F.col(id_col).between(r["first"], r["last"]))
        build(part).write.mode("overwrite").parquet(f"{path}/rows/batch={r['batch']}")
        seen = digest(spark.read.parquet(f"{path}/rows/batch={r['batch']}"))
        record = seen.select(F.lit(r["batch"]).alias("batch"), F.lit(r["first"]).cast("long").alias("first"), F.lit(r["last"]).cast("long").alias("last"), "n_rows", "content_sha256")
        record.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={r['batch']}")
        done += 1
    return done


def finalised(spark: SparkSession, path: str) -> DataFrame:
    """The whole table. Raises if a batch is missing, or if a batch's rows no longer have the digest of its commit."""
    if not _exists(spark, f"{path}/plan"):
        raise ValueError(f"nothing was planned below {path}")
    plan = spark.read.schema(_PLAN).parquet(f"{path}/plan").orderBy("batch").collect()
    done = commits(spark, path, len(plan))
    if len(done) < len(plan):
        raise ValueError(f"{len(done)} of {len(plan)} batches below {path} are committed")
    for r, p in zip(done, plan, strict=True):
        if (r["first"], r["last"]) != (p["first"], p["last"]):
            raise ValueError(f"batch {r['batch']} below {path} has another range than planned")
        seen = digest(spark.read.parquet(f"{path}/rows/batch={r['batch']}")).first()
        if (seen["n_rows"], seen["content_sha256"]) != (r["n_rows"], r["content_sha256"]):
            raise ValueError(f"batch {r['batch']} below {path} was changed after its commit")
    if not plan:
        return spark.createDataFrame([], "batch int")
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={r['batch']}" for r in plan])
