"""Scores of predictions against references, and resampling statistics.

Texts are compared by lower-cased words. Null texts have no words; two texts without words agree fully. Rows with equal ids are rows of
their own only where an id is no join key: give each row its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import squeezed, words


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is one integer, a bit for each place of b, so that a step is a few operations on whole words of bits."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(b) - row.bit_count()


def _subsequences(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        yield pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="int64")


def _common(a: str, b: str) -> Column:
    return F.pandas_udf(_subsequences, LongType())(a, b)


def _f(same: Column, of_a: Column, of_b: Column) -> Column:
    both = of_a + of_b
    return F.round(F.when(both == 0, F.lit(1.0)).otherwise(2.0 * same / F.greatest(both, F.lit(1))), 9)


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short lists: over distinct words the smaller count."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def _overlaps(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        yield pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(left, right, strict=True)], dtype="int64")


def best_of_answers(rows: DataFrame, id_col: str, text: str, answers: str) -> DataFrame:
    """id, exact, f1, rouge_l, in_text: the best of each score over the answers (an array), and whether an answer occurs in the text.

    No answers: all scores are 0. ROUGE-L is the F of the longest common subsequence of words.
    """
    each = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.explode_outer(answers).alias("answer")).select(
        "_id", F.col("answer").isNotNull().alias("real"), words(F.col("_text")).alias("p"), words(F.col("answer")).alias("g"), squeezed(F.col("_text")).alias("sp"), squeezed(F.col("answer")).alias("sg")
    )
    each = each.withColumn("lcs", _common("p", "g")).withColumn("same", F.pandas_udf(_overlaps, LongType())("p", "g"))
    n_p, n_g = F.size("p"), F.size("g")
    score = lambda c: F.max(F.when(F.col("real"), c).otherwise(0.0))
    found = F.col("real") & (F.length("sg") > 0) & F.contains(F.col("sp"), F.col("sg"))
    return each.groupBy(F.col("_id").alias(id_col)).agg(
        F.max((F.col("real") & (F.col("sp") == F.col("sg"))).cast("int")).alias("exact"),
        score(_f(F.col("same"), n_p, n_g)).alias("f1"),
        score(_f(F.col("lcs"), n_p, n_g)).alias("rouge_l"),
        F.max(found.cast("int")).alias("in_text"),
    )


def _grams(w: Column, n: int) -> Column:
    many = F.size(w) >= n
    starts = F.when(many, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))


def rouge_n(rows: DataFrame, id_col: str, text: str, gold: str) -> DataFrame:
    """id, rouge_1, rouge_2: F of the overlap of distinct n-grams of words."""
    w = rows.select(id_col, words(F.col(text)).alias("p"), words(F.col(gold)).alias("g"))

    def one(n: int) -> Column:
        a, b = _grams(F.col("p"), n), _grams(F.col("g"), n)
        return _f(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)).alias(f"rouge_{n}")

    return w.select(id_col, one(1), one(2))


def sequence_order(rows: DataFrame, id_col: str, actions: str, gold: str) -> DataFrame:
    """id, lcs, order_accuracy: longest common subsequence of actions over the number of gold actions; without gold 1."""
    out = rows.select(id_col, F.size(gold).alias("n"), _common(actions, gold).alias("lcs"))
    return out.select(id_col, "lcs", F.round(F.when(F.col("n") > 0, F.col("lcs") / F.col("n")).otherwise(1.0), 9).alias("order_accuracy"))


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def fact_alignment(rows: DataFrame, id_col: str, text: str, gold: str, least: float = 0.5) -> DataFrame:
    """id, precision, recall: shares of sentences of the text, and of the gold text, that some sentence of the other side
    reaches a word F1 of `least` with. A side without sentences has share 1 if both have none, else 0."""
    p, g = (F.transform(_sentences(F.col(c)), lambda s: words(s)) for c in (text, gold))
    alike = lambda a, b: _f(_overlap(a, b), F.size(a), F.size(b)) >= least
    found = rows.select(id_col, p.alias("p"), g.alias("g"))
    hit = lambda one, other: F.size(F.filter(one, lambda a: F.exists(other, lambda b: alike(a, b))))
    share = lambda one, other: F.when(F.size(one) > 0, hit(one, other) / F.size(one)).otherwise(F.when(F.size(other) == 0, 1.0).otherwise(0.0))
    return found.select(id_col, F.round(share(F.col("p"), F.col("g")), 9).alias("precision"), F.round(share(F.col("g"), F.col("p")), 9).alias("recall"))


def evidence_match(rows: DataFrame, id_col: str, text: str, gold: str, longer_than: int = 3) -> DataFrame:
    """id, precision, recall of evidence sentences: a pair matches by containment (24 characters or more), or if the shared
    terms are at least 0.35 of the gold's or 0.60 of the predicted one's. No gold evidence: both 1."""
    terms = lambda s: F.array_distinct(F.filter(words(s), lambda w: F.length(w) > longer_than))
    unit = lambda c: F.transform(_sentences(F.col(c)), lambda s: F.struct(F.lower(s).alias("s"), terms(s).alias("t")))
    both = rows.select(id_col, unit(text).alias("p"), unit(gold).alias("g"))

    def alike(p, g):
        inside = lambda a, b: (F.length(a) >= 24) & F.contains(b, a)
        same = F.size(F.array_intersect(p["t"], g["t"]))
        return inside(p["s"], g["s"]) | inside(g["s"], p["s"]) | ((same > 0) & ((same >= 0.35 * F.size(g["t"])) | (same >= 0.6 * F.size(p["t"]))))

    n_p, n_g = F.size("p"), F.size("g")
    hit_p = F.size(F.filter("p", lambda p: F.exists("g", lambda g: alike(p, g))))
    hit_g = F.size(F.filter("g", lambda g: F.exists("p", lambda p: alike(p, g))))
    share = lambda hit, n: F.round(F.when(n_g == 0, 1.0).when(n == 0, 0.0).otherwise(hit / F.greatest(n, F.lit(1))), 9)
    return both.select(id_col, share(hit_p, n_p).alias("precision"), share(hit_g, n_g).alias("recall"))


def tool_choice(rows: DataFrame, id_col: str, field: str, text: str, gold: str, names: list[str]) -> DataFrame:
    """id, chosen, correct: the tool from its field, from `tool=name` in the text, or from the only name mentioned; null without gold."""
    tagged = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"tool=([A-Za-z_]+)", 1), F.lit(""))
    spoken = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(words(F.col(text)), n))
    chosen = F.coalesce(F.col(field), tagged, F.when(F.size(spoken) == 1, spoken[0]))
    return rows.select(id_col, chosen.alias("chosen"), F.when(F.col(gold).isNotNull(), F.coalesce(chosen == F.col(gold), F.lit(False)).cast("int")).alias("correct"))


def _draws(units: DataFrame, by: list[str], key: str, samples: int, seed: int) -> DataFrame:
    """Each replicate's units: as many draws with replacement as there are units, by digests, whatever the partitioning."""
    order = Window.partitionBy(*by).orderBy(key)
    placed = units.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))  # a row for each cluster
    asked = placed.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in by], F.col("replicate").cast("string"), F.col("i").cast("string"))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("n")
    return asked.select(*by, "replicate", drawn.cast("int").alias("i")).join(placed.drop("n"), [*by, "i"])


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, samples: int = 200, seed: int = 13, by: str | None = None) -> DataFrame:
    """(by,) n_clusters, mean, low, high: the mean with its bootstrap interval over clusters that stay together (95 %).

    Rows are added up by cluster first: the replicates then cost clusters x samples, however many rows there are. With
    one cluster both bounds are the mean. Null values are left out. Percentiles are taken at 0-based rank int(0.025 (B - 1)) and int(0.975 (B - 1)).
    """
    rows = rows.withColumn("_by", F.col(by).cast("string") if by else F.lit("all"))
    units = rows.where(F.col(value).isNotNull()).groupBy("_by", F.col(cluster).alias("_k")).agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    each = _draws(units, ["_by"], "_k", samples, seed).groupBy("_by", "replicate").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    ranked = F.array_sort(F.collect_list(F.round("m", 9)))
    bounds = each.groupBy("_by").agg(ranked[int(0.025 * (samples - 1))].alias("low"), ranked[int(0.975 * (samples - 1))].alias("high"))
    mean = units.groupBy("_by").agg(F.count("*").alias("n_clusters"), F.round(F.sum("_s") / F.sum("_c"), 9).alias("mean"))
    out = mean.join(bounds, "_by")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def _sampled_flips(d: DataFrame, samples: int, seed: int) -> DataFrame:
    """replicate, s: sums of the differences (v, in 1e-9) under signs that are bits of the digest of seed, key and block of 128 replicates.

    A task sends one sum for each replicate, however many pairs it has.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(samples, np.int64)
        for batch in batches:
            for key, v in zip(batch["key"], batch["v"], strict=True):
                digests = b"".join(hashlib.md5(f"{seed}:{key}:{b}".encode(), usedforsecurity=False).digest() for b in range(-(-samples // 128)))
                sums += np.where(np.unpackbits(np.frombuffer(digests, np.uint8))[:samples] == 1, -v, v)
        yield pd.DataFrame({"replicate": np.arange(samples), "s": sums})

    return d.mapInPandas(partial, "replicate int, s long").groupBy("replicate").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def sign_flip_test(deltas: DataFrame, key: str, delta: str, most: int = 14, samples: int = 4096, seed: int = 17) -> DataFrame:
    """n, mean, p of paired differences: the share of sign patterns whose mean is at least as far from 0.

    Up to `most` pairs all 2 ** n patterns are taken; beyond, `samples` patterns, whose signs rest on seed and keys alone, not on order or partitioning.
    Null differences are left out, null keys are keys; without any pair there is no row. Rows of one key share their signs: give each pair its own. Sampled sums are exact in steps of 1e-9, for
    differences below 1e9 divided by the number of pairs.
    """
    d = deltas.where(F.col(delta).isNotNull()).select(key, F.round(delta, 9).alias("d"))
    n = d.count()
    if n > most:
        v = d.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.round(F.col("d") * 1e9).cast("long").alias("v"))
        seen = d.agg(F.round(F.avg("d"), 9).alias("mean"), F.count("*").alias("n")).join(v.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("obs")))
        sums = _sampled_flips(v, samples, seed)
        return sums.join(F.broadcast(seen)).groupBy("n", "mean").agg(F.round(F.avg((F.abs("s") >= F.abs("obs")).cast("double")), 9).alias("p"))
    placed = d.withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)  # `most` rows at most
    sign = lambda m, i: F.when(F.floor(m / F.pow(F.lit(2), i)) % 2 == 1, -1.0).otherwise(1.0)
    masks = placed.select("i", "d", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("m"))
    sums = masks.groupBy("m").agg(F.round(F.sum(F.col("d") * sign(F.col("m"), F.col("i"))), 6).alias("s"))
    seen = placed.agg(F.round(F.sum("d"), 6).alias("obs"), F.round(F.avg("d"), 9).alias("mean"), F.count("*").alias("n"))
    return sums.join(F.broadcast(seen)).groupBy("n", "mean").agg(F.round(F.avg((F.abs("s") >= F.abs("obs")).cast("double")), 9).alias("p"))
