"""Checks of tables against each other and against what is expected of them; each gives rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protocol(rows: DataFrame, category: str, id_col: str, expected: int) -> DataFrame:
    """category, n, n_ids, verdict: whether a category has at least `expected` rows and no id twice."""
    out = rows.groupBy(category).agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("n_ids"))
    return out.withColumn("verdict", F.when(F.col("n") != F.col("n_ids"), "repeated").when(F.col("n") < expected, "short").otherwise("ok"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that one side has more often than the other, with side and surplus. Rows are counted before they meet."""
    names = left.columns
    sides = left.select(*names, F.lit(1).alias("d")).unionByName(right.select(*names, F.lit(-1).alias("d")))
    out = sides.groupBy(*names).agg(F.sum("d").alias("d")).where("d <> 0")
    return out.select(*names, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("surplus"))


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """key, n: end points that no parent row has."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def ledger(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, n, last, closed: closed if a group's places are exactly its first to its last, each once."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.count_distinct(order).alias("places"))
    return out.select(group, "n", "last", ((F.col("n") == F.col("places")) & (F.col("last") - F.col("first") + 1 == F.col("n"))).alias("closed"))


def rates(rows: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """by, n and the share of rows that meet each condition; a null condition is not met."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9).alias(k) for k, c in conditions.items()])


def reconciled(expected: DataFrame, found: DataFrame, id_col: str, subset: str) -> DataFrame:
    """subset, n_expected, n_found, n_missing, n_extra, complete: ids of two tables compared in each subset."""
    one = lambda df, flag: df.select(subset, id_col).distinct().withColumn(flag, F.lit(True))
    both = one(expected, "_e").join(one(found, "_f"), [subset, id_col], "full")
    e, f = F.col("_e").isNotNull(), F.col("_f").isNotNull()
    out = both.groupBy(subset).agg(F.count_if(e).alias("n_expected"), F.count_if(f).alias("n_found"), F.count_if(e & ~f).alias("n_missing"), F.count_if(f & ~e).alias("n_extra"))
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def differing(rows: DataFrame, group: str, recorded: str, computed: str, tolerance: float) -> DataFrame:
    """group, n, n_off: how many recorded values differ from the computed ones by more than the tolerance; one null of the two differs, two do not."""
    r, c = F.col(recorded), F.col(computed)
    off = (r.isNull() != c.isNull()) | (F.abs(r - c) > tolerance)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("n_off"))


def writeback(accepted: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accepted (rows), recorded (a count), closed: whether both agree; a side without the key counts 0."""
    both = accepted.groupBy(*keys).agg(F.count("*").alias("accepted")).join(recorded, keys, "full_outer")
    a, r = F.coalesce("accepted", F.lit(0)), F.coalesce("recorded", F.lit(0))
    return both.select(*keys, a.alias("accepted"), r.alias("recorded"), (a == r).alias("closed"))


def closed_from_one(ledger: DataFrame, owner: str, step: str) -> DataFrame:
    """owner, n, first, last, closed: whether the steps are exactly 1 to n, each once or more."""
    out = ledger.groupBy(owner).agg(F.count("*").alias("n"), F.min(step).alias("first"), F.max(step).alias("last"), F.count_distinct(step).alias("d"))
    return out.select(owner, "n", "first", "last", ((F.col("first") == 1) & (F.col("last") == F.col("d"))).alias("closed"))


def provenance(units: DataFrame, known: DataFrame, group: str, at: str, most_direct: int, most_transitive: int) -> DataFrame:
    """group, at, kind, n_sources, verified, no_future of every unit (group, at, direct, cited: array of places).

    Of the cited places the latest `most_direct` (direct units) or `most_transitive` count. kind: unsourced, direct or transitive;
    verified: there is a source and all are known (group, source); no_future: none is at or after the unit. Null citations are none.
    """
    cited = F.filter(F.coalesce("cited", F.array().cast(dict(units.dtypes)["cited"])), lambda x: x.isNotNull())
    most = F.when(F.coalesce("direct", F.lit(False)), most_direct).otherwise(most_transitive)
    kept = F.array_distinct(F.slice(F.sort_array(cited, asc=False), F.lit(1), most))
    kind = F.when(F.size(cited) == 0, "unsourced").when(F.coalesce("direct", F.lit(False)), "direct").otherwise("transitive")
    rows = units.select(group, at, kind.alias("kind"), kept.alias("kept"))
    each = rows.select(group, at, F.explode("kept").alias("source")).join(known.distinct().withColumn("there", F.lit(1)), [group, "source"], "left")
    checked = each.groupBy(group, at).agg(F.count("*").alias("n_sources"), F.count("there").alias("n_known"), F.max("source").alias("latest"))
    out = rows.join(checked, [group, at], "left")
    verified = F.coalesce(F.col("n_sources") == F.col("n_known"), F.lit(False))
    return out.select(group, at, "kind", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), verified.alias("verified"), F.coalesce(F.col("latest") < F.col(at), F.lit(True)).alias("no_future"))


def record_check(texts: DataFrame, records: DataFrame, id_col: str, text: str, least: int, most: int) -> DataFrame:
    """id, n_chars, digest, verdict: what each text's length and sha256 are, against what its record (id, n_chars, digest) states.

    Verdicts, the first that applies: no_text, missing (no record), repeated (several), length, digest, band (not `least` to `most` characters),
    ok. A null text counts as empty; a record's null differs from any value; of repeated texts each is held against the record.
    """
    n, digest = F.length(F.coalesce(text, F.lit(""))), F.sha2(F.coalesce(text, F.lit("")), 256)
    now = texts.select(id_col, n.cast("long").alias("n_chars"), digest.alias("digest"))
    stated = records.groupBy(id_col).agg(F.count("*").alias("_records"), F.min("n_chars").alias("_n"), F.min("digest").alias("_d"))
    both = now.join(stated, id_col, "full_outer")
    verdict = (
        F.when(F.col("digest").isNull(), "no_text").when(F.col("_records").isNull(), "missing").when(F.col("_records") > 1, "repeated")
        .when(~F.col("n_chars").eqNullSafe(F.col("_n")), "length").when(~F.col("digest").eqNullSafe(F.col("_d")), "digest")
        .when(~F.col("n_chars").between(least, most), "band").otherwise("ok")
    )
    return both.select(id_col, "n_chars", "digest", verdict.alias("verdict"))
