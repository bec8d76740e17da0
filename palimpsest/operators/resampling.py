"""Bootstrap over single rows by Poisson weights: each row's weight in each replicate is drawn on its own, so no row is gathered or joined to its draws.

A row's weight is Poisson with mean 1, from 16 bits of the digest of seed, key and block of eight replicates: a replicate then holds n rows on
average instead of exactly n, which for a mean of many rows gives the same interval. Weights rest on seed and keys alone, not on order or
partitioning; rows of one key share theirs, so give each row its own. Sums are exact in steps of 1e-9 for values below 1e9. Null values are
left out, null keys are the empty key, a null group is a group, and an empty table gives no row. A replicate that draws none of a group's rows
has no mean there; with one row in a group both bounds are its value.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A 16-bit number gives the weight k if k of these are not above it.
POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
_GROUPS = 1000


def weights(seed: int, key: str, samples: int) -> np.ndarray:
    digests = b"".join(hashlib.md5(f"{seed}:{key}:{b}".encode(), usedforsecurity=False).digest() for b in range(-(-samples // 8)))
    return np.searchsorted(POISSON, np.frombuffer(digests, ">u2")[:samples].astype(np.int64), side="right")


def replicate_means(rows: DataFrame, by: str, key: str, value: str, samples: int, seed: int) -> DataFrame:
    """by, replicate, m (rounded to 9 places). A task sends one pair of sums for each group and replicate that it has; it holds a thousand groups at most."""
    v = F.round(F.col(value).cast("double") * 1e9).cast("long")
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    plain = usable.select(F.col(by).cast("string").alias("by"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), v.alias("v"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            frames = [pd.DataFrame({"by": by, "replicate": np.arange(samples), "w": s[0], "high": s[1], "low": s[2]}) for by, s in held.items()]
            held.clear()
            return pd.concat(frames)

        for batch in batches:
            for by, key, v in zip(batch["by"], batch["key"], batch["v"], strict=True):
                by = None if pd.isna(by) else by
                if by not in held and len(held) >= _GROUPS:
                    yield out()
                w = weights(seed, key, samples)
                # values in two parts, so that sums of many rows stay inside 64 bits
                held.setdefault(by, np.zeros((3, samples), np.int64))
                held[by] += w * np.array([[1], [v >> 32], [v & 0xFFFFFFFF]])
        if held:
            yield out()

    parts = plain.mapInPandas(sums, "by string, replicate int, w long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    total = parts.groupBy("by", "replicate").agg(F.sum("w").alias("w"), (whole("high") * F.lit(1 << 32) + whole("low")).cast("double").alias("s"))
    return total.where("w > 0").select(F.col("by").alias(by), "replicate", F.round(F.col("s") / F.col("w") / 1e9, 9).alias("m"))


def _at(ranked: Column, share: float) -> Column:
    return F.element_at(ranked, F.floor(F.lit(share) * (F.size(ranked) - 1)).cast("int") + 1)


def mean_bootstrap(rows: DataFrame, by: str, key: str, value: str, samples: int = 1000, seed: int = 13) -> DataFrame:
    """by, n, mean, low, high: each group's mean with its 95 % interval, at 0-based ranks int(0.025 (B - 1)) and int(0.975 (B - 1)) of the B replicate means."""
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    seen = usable.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    ranked = F.array_sort(F.collect_list("m"))  # one number for each replicate
    bounds = replicate_means(rows, by, key, value, samples, seed).groupBy(F.col(by).alias("_by")).agg(F.round(_at(ranked, 0.025), 6).alias("low"), F.round(_at(ranked, 0.975), 6).alias("high"))
    return seen.join(bounds, seen[by].eqNullSafe(bounds["_by"]), "left").drop("_by")


def stratified_bootstrap(rows: DataFrame, stratum: str, key: str, difference: str, samples: int = 1000, seed: int = 13) -> DataFrame:
    """n_strata, difference, low, high, p of the mean over strata of each stratum's mean paired difference.

    Bounds are at 0-based ranks max(0, int(0.025 B) - 1) and min(B - 1, int(0.975 B)); p is two-sided: twice (1 + the smaller of the counts of
    replicates at or below 0, and at or above it) in B + 1, at most 1.
    """
    usable = rows.where(F.col(difference).isNotNull() & ~F.isnan(F.col(difference).cast("double")))
    each = usable.groupBy(stratum).agg(F.round(F.avg(difference), 9).alias("d"))
    seen = each.agg(F.count("*").alias("n_strata"), F.round(F.avg("d"), 6).alias("difference"))
    macro = replicate_means(rows, stratum, key, difference, samples, seed).groupBy("replicate").agg(F.round(F.avg("m"), 9).alias("m"))
    ranked, b = F.array_sort(F.collect_list("m")), F.count("*")
    low, high = F.greatest(F.lit(0), F.floor(0.025 * b) - 1).cast("int") + 1, F.least(b - 1, F.floor(0.975 * b)).cast("int") + 1
    less = F.least(F.count_if(F.col("m") <= 0), F.count_if(F.col("m") >= 0))
    p = F.least(F.lit(1.0), 2.0 * (less + 1) / (b + 1))
    drawn = macro.agg(ranked.alias("ms"), low.alias("lo"), high.alias("hi"), F.round(p, 9).alias("p")).where("size(ms) > 0")
    drawn = drawn.select(F.round(F.element_at("ms", F.col("lo")), 6).alias("low"), F.round(F.element_at("ms", F.col("hi")), 6).alias("high"), "p")
    return seen.where("n_strata > 0").join(F.broadcast(drawn))  # one row each
