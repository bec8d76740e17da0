"""Scores of predictions, activity and usage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, words


def answer_scores(rows: DataFrame, id_col: str, predicted: str, gold: str) -> DataFrame:
    """id, exact, f1: normalised exact match and F1 over the multiset of words."""
    p = rows.select(id_col, F.explode(words(F.col(predicted))).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("np"))
    g = rows.select(id_col, F.explode(words(F.col(gold))).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("ng"))
    both = p.join(g, [id_col, "w"]).groupBy(id_col).agg(F.sum(F.least("np", "ng")).alias("same"))
    n = rows.select(id_col, (squeezed(F.col(predicted)) == squeezed(F.col(gold))).cast("int").alias("exact"), F.size(words(F.col(predicted))).alias("n_p"), F.size(words(F.col(gold))).alias("n_g")).join(both, id_col, "left")
    f1 = F.when(F.col("n_p") + F.col("n_g") == 0, 1.0).otherwise(2.0 * F.coalesce("same", F.lit(0)) / (F.col("n_p") + F.col("n_g")))
    return n.select(id_col, "exact", F.round(f1, 9).alias("f1"))


def activity(items: DataFrame, group: str, id_col: str, unresolved: Column, refs: Column, importance: Column, age: Column, top: int) -> DataFrame:
    """group, id, score, rank: (0.45 unresolved + 0.30 min(1, log2(1 + refs) / 3) + 0.25 importance / 5) * 2 ** (-age / 40), the best of each group."""
    value = (0.45 * unresolved + 0.30 * F.least(F.lit(1.0), F.log2(1 + refs) / 3) + 0.25 * importance / 5) * F.pow(F.lit(2.0), -age / 40)
    scored = items.select(group, id_col, F.round(value, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), id_col))).where(F.col("rank") <= top)


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, half_width: 1.96 s / sqrt(n), and 0 where n is 1."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    return out.select(*by, "n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("n") > 1, 1.96 * F.col("s") / F.sqrt("n")).otherwise(0.0), 6).alias("half_width"))


def usage(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by (with totals as null), calls, total, missing: missing usage is counted, not taken as 0."""
    return rows.cube(*by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"), F.sum(F.col(value).isNull().cast("int")).alias("missing"))


def wilson(rows: DataFrame, by: str, hit: str, z: float = 1.96) -> DataFrame:
    """by, n, rate, low, high: the Wilson interval of a 0/1 column."""
    out = rows.groupBy(by).agg(F.count(hit).alias("n"), F.avg(hit).alias("rate"))
    n, p = F.col("n"), F.col("rate")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return out.select(by, "n", F.round(p, 9).alias("rate"), F.round(centre - half, 9).alias("low"), F.round(centre + half, 9).alias("high"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, to 1e-10 from x = 10 on."""
    return (x - 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(2 * 3.141592653589793)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))


def mcnemar(pairs: DataFrame, by: str, first: str, second: str) -> DataFrame:
    """by, only_first, only_second, p: the exact two-sided test on discordant pairs; p is 1 without any.

    The binomial tail is added up from 12 standard deviations below its largest term on: what comes before is under 1e-30 of it, and a group's
    work grows with the square root of its discordant pairs.
    """
    only = lambda x, y: F.sum(((F.col(x) == 1) & (F.col(y) == 0)).cast("long"))
    out = pairs.groupBy(by).agg(only(first, second).alias("only_first"), only(second, first).alias("only_second"))
    out = out.withColumn("n", F.col("only_first") + F.col("only_second")).withColumn("k", F.least("only_first", "only_second"))
    start = F.col("k") - F.ceil(12 * F.sqrt("n")) - 50
    out = out.withColumn("lo", F.when(start < 10, 0).otherwise(start).cast("long"))
    n, k, lo = F.col("n"), F.col("k"), F.col("lo")
    before = F.when(lo > 0, _log_gamma(n + 1.0) - _log_gamma(lo + 1.0) - _log_gamma(n - lo + 1.0)).otherwise(0.0) - n * F.log(F.lit(2.0))
    # Log binomials as a running sum, so that large counts neither overflow nor vanish.
    log_term = lambda s, i: s["t"] + F.when(i > lo, F.log((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)
    step = lambda s, i: F.struct(log_term(s, i).alias("t"), (s["p"] + F.exp(log_term(s, i))).alias("p"))
    tail = F.aggregate(F.sequence(lo, k), F.struct(before.alias("t"), F.lit(0.0).alias("p")), step)
    return out.select(by, "only_first", "only_second", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail["p"])), 6).alias("p"))


def holm(tests: DataFrame, family: str, name: str, p: str) -> DataFrame:
    """family, name, adjusted: Holm's step-down p values."""
    w = Window.partitionBy(family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(family))
    stepped = tests.select(family, name, F.col(p).alias("p"), F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)).alias("x"))
    return stepped.select(family, name, F.round(F.max("x").over(Window.partitionBy(family).orderBy("p", name).rowsBetween(Window.unboundedPreceding, 0)), 9).alias("adjusted"))


def round_rates(rows: DataFrame, by: str, round_col: str, score: Column) -> DataFrame:
    """by, mean, spread: mean and population deviation, over rounds, of each round's mean score."""
    rounds = rows.groupBy(by, round_col).agg(F.avg(score).alias("r"))
    return rounds.groupBy(by).agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.stddev_pop("r"), 9).alias("spread"))


def amortised(builds: DataFrame, questions: DataFrame, key: str, cost: str, own: str) -> DataFrame:
    """key, n, per_question: each build's cost counted once and shared by its questions, plus their own mean cost."""
    q = questions.groupBy(key).agg(F.count("*").alias("n"), F.sum(own).alias("own"))
    return builds.select(key, cost).join(q, key).select(key, "n", F.round((F.col(cost) + F.col("own")) / F.col("n"), 6).alias("per_question"))


def breakdown(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """dimension, level, n, mean: every dimension's levels and the total in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("level")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims])
    return rows.select(F.inline(pairs), F.col(value).alias("v")).groupBy("dimension", "level").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def macro_difference(rows: DataFrame, stratum: str, first: str, second: str) -> DataFrame:
    """n_strata, difference: the mean over strata of each stratum's mean paired difference."""
    each = rows.groupBy(stratum).agg(F.avg(F.col(first) - F.col(second)).alias("d"))
    return each.agg(F.count("d").alias("n_strata"), F.round(F.avg("d"), 9).alias("difference"))


def strongest(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """by, best, mean, lead: the name of the highest mean, and how far it is ahead of the second; ties to the smaller name."""
    w = Window.partitionBy(by).orderBy(F.desc("mean"), name)
    means = rows.groupBy(by, name).agg(F.round(F.avg(value), 6).alias("mean"))
    out = means.select(by, F.col(name).alias("best"), "mean", F.round(F.col("mean") - F.lead("mean").over(w), 6).alias("lead"), F.row_number().over(w).alias("rn"))
    return out.where("rn = 1").drop("rn")


def judged(judgments: DataFrame, rows: DataFrame, id_col: str, digest: str, group: str, correct: str) -> DataFrame:
    """group (null: all), n, n_stale, accuracy: over judgments whose digest is still that of the row; the others are counted as stale."""
    now = rows.select(id_col, group, F.col(digest).alias("_now"))
    seen = judgments.join(now, id_col).withColumn("_fresh", F.coalesce(F.col(digest) == F.col("_now"), F.lit(False)))
    fresh = F.when(F.col("_fresh"), F.col(correct))
    return seen.rollup(group).agg(F.count(fresh).alias("n"), F.count_if(~F.col("_fresh")).alias("n_stale"), F.round(F.avg(fresh), 6).alias("accuracy"))


def unit_costs(rows: DataFrame, method: str, cost: str, progress: Column) -> DataFrame:
    """method, n, n_progress, rate, unit_cost: cost of a step of progress; null where a method made none."""
    n, made = F.count(F.lit(1)), F.count_if(progress)
    out = rows.groupBy(method).agg(n.alias("n"), made.alias("n_progress"), F.sum(cost).alias("_cost"))
    return out.select(method, "n", "n_progress", F.round(F.col("n_progress") / F.col("n"), 6).alias("rate"), F.round(F.col("_cost") / F.nullif(F.col("n_progress"), F.lit(0)), 4).alias("unit_cost"))


def deltas(rows: DataFrame, run: str, method: str, value: str, baseline: str) -> DataFrame:
    """run, method, mean, delta: each method's mean less the baseline's in the same run; null where the run has no baseline."""
    means = rows.groupBy(run, method).agg(F.avg(value).alias("_mean"))
    base = means.where(F.col(method) == baseline).select(run, F.col("_mean").alias("_base"))
    return means.join(base, run, "left").select(run, method, F.round("_mean", 6).alias("mean"), F.round(F.col("_mean") - F.col("_base"), 6).alias("delta"))


def reliability(pairs: DataFrame, by: str, first: str, second: str, samples: int = 10_000, seed: int = 20260801) -> DataFrame:
    """by, n, only_first, only_second, delta (mean of first less second), low, high: the 95 % interval of delta over resampled pairs.

    A group's pairs are added up to three counts first (only first, only second, alike), and a replicate is one multinomial draw of them: its cost does not grow with the pairs. The draws of
    a group rest on the seed and the group's name alone, not on partitioning. Bounds are at 0-based rank int(0.025 B) and int(0.975 B). Pairs with a null on either side are left out; a null group is a group.
    """
    both = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    only = lambda x, y: F.sum(((F.col(x) == 1) & (F.col(y) == 0)).cast("long"))
    counts = both.groupBy(F.col(by).alias("by")).agg(F.count("*").alias("n"), only(first, second).alias("only_first"), only(second, first).alias("only_second"))
    kind = dict(counts.dtypes)["by"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for by, n, a, b in zip(batch["by"], batch["n"], batch["only_first"], batch["only_second"], strict=True):
                name = "-" if pd.isna(by) else f"={by}"
                rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                drawn = rng.multinomial(n, [a / n, b / n, (n - a - b) / n], samples)
                deltas = np.sort((drawn[:, 0] - drawn[:, 1]) / n)
                rows.append((by, n, a, b, round((a - b) / n, 9), round(float(deltas[int(0.025 * samples)]), 9), round(float(deltas[int(0.975 * samples)]), 9)))
            yield pd.DataFrame(rows, columns=["by", "n", "only_first", "only_second", "delta", "low", "high"])

    found = counts.mapInPandas(draw, f"by {kind}, n long, only_first long, only_second long, delta double, low double, high double")
    return found.withColumnRenamed("by", by)
