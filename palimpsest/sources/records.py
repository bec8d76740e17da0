"""Reading records of several formats, and writing them with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, path: str, kind: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """Records of a folder tree with _source_file and _source_stem: csv, tsv, jsonl, json (arrays or single objects), wrapped or parquet.

    wrapped: JSON objects whose lists of records are the rows; _list names the list. Bad JSON stays as _corrupt_record (see `corrupt_counts`).
    limit: at most so many records of each file, in no promised order.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", "_corrupt_record")
    df = {
        "csv": lambda: reader.csv(path, header=True, inferSchema=True),
        "tsv": lambda: reader.csv(path, header=True, inferSchema=True, sep="\t"),
        "jsonl": lambda: reader.json(path),
        "json": lambda: reader.option("multiLine", "true").json(path),
        "wrapped": lambda: reader.option("multiLine", "true").json(path),
        "parquet": lambda: reader.parquet(path),
    }[kind]()
    name = F.col("_metadata.file_name")
    df = df.withColumn("_source_file", name).withColumn("_source_stem", F.regexp_replace(name, r"\.[^.]*$", ""))
    if kind == "wrapped":
        df = _unwrapped(df)
    if limit is not None:
        nth = F.row_number().over(Window.partitionBy("_source_file").orderBy(F.monotonically_increasing_id()))
        df = df.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
    return df


def _unwrapped(df: DataFrame) -> DataFrame:
    """One row a record of the lists of records; the schema says which columns are such lists."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    out = None
    for c in lists:
        one = df.select("_source_file", "_source_stem", F.lit(c).alias("_list"), F.inline(c))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return df if out is None else out


def corrupt_counts(records: DataFrame) -> DataFrame:
    """_source_file, n, n_corrupt: how many records of each file could not be read as JSON."""
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in records.columns else F.lit(False)
    return records.groupBy("_source_file").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("n_corrupt"))


def write_wide_csv(rows: DataFrame, row: str, column: str, value: str, path: str, most: int = 2000) -> list[str]:
    """A CSV with a header: one line a row, one column for each value of `column` (counted first: beyond `most` this raises), empty where absent."""
    names = [r[0] for r in rows.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{column} has more than {most} values: write long rows instead")
    wide = rows.groupBy(row).pivot(column, names).agg(F.first(value, ignorenulls=True))
    wide.write.mode("errorifexists").option("header", "true").csv(path)
    return names


def digest(df: DataFrame) -> DataFrame:
    """n_rows and content_sha256, free of row order: the digest of exact sums over the parts of all rows' digests, so that nothing is collected."""
    row = df.select(F.sha2(F.to_json(F.struct(*[df[c] for c in df.columns])), 256).alias("h"))
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return row.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(i) for i in range(4)]), 256).alias("content_sha256"))


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows as JSON lines; the manifest row has number and digest of what was written, read back with the frame's types."""
    df.write.mode("errorifexists").json(path)
    return digest(df.sparkSession.read.schema(df.schema).json(path)).withColumn("path", F.lit(path))
