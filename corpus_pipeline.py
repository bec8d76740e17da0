"""A corpus pipeline of five stages over the documents table; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import load, materialize
from palimpsest.llm.decontaminate import contamination
from palimpsest.llm.near_dedup import near_duplicates, with_set_ids
from palimpsest.llm.pieces import encoded, read_pieces
from palimpsest.llm.quality import quality_scores
from palimpsest.llm.substring_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_scores(docs, "lang", "source", "n_chars").where("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays; of rows that repeat it, one.

    Rows that share a doc_id are told apart by their sets of shingles: those in different groups do not displace each other.
    Documents without words and rows without doc_id are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs).where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0))
    first = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "set_id")).alias("first")).select("first.doc_id", "first.set_id")
    alone = docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rest = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kept = with_set_ids(rest).join(first, ["doc_id", "set_id"], "left_semi")
    return kept.dropDuplicates(["doc_id", "set_id"]).select(*COLUMNS).unionByName(alone).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out of the text; n_chars follows."""
    cut = without_repeats(docs, 13, "lang", "source", "n_chars").drop("text").withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    clean = contamination(docs, load(spark, sf_dir, "benchmark"), 10, "lang", "source", "n_chars").where("n_hit = 0")
    return clean.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces, round_trip of every document."""
    import public_tokenizers

    out = encoded(docs, read_pieces(public_tokenizers.path("piece_bpe_32k.model")), "lang", "source")
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]
#: The quality scorer is learned, and its decisions feed all later stages: SQL can't express run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
