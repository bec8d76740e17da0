"""Language ID by Bayesian evidence fusion over web pages.

    log P(language | page) = text likelihood (tempered) + log P(declared language | language) + log P(language | host) + const

1. The text model is a multinomial one over hashed byte trigrams; its counts are a grouped aggregate of all documents with a known
   language (a fixed number of counts for each language).
2. Each page's text posterior, with equal priors, is written once.
3. Grouped sums of these posteriors give, smoothed level by level, P(language), P(language | address suffix) and P(language |
   host), and P(declared | language) for what the markup declares. A page's own posterior is taken off the sums of its host, suffix and
   declaration first, so that no evidence counts twice.
4. Joins on host, suffix and declaration fuse them. The sums are written and counted: up to `BROADCAST_KEYS` of them are broadcast,
   beyond that both sides are plain shuffles, of which the skew-join rule splits a hot host.

Pages with null url have the host and suffix "", pages without a declaration the declaration "". Null html has no text; such
pages go by the other evidence. Without training languages the result's language is null. Repeated pages are evidence each
and are scored each; ties go to the first language in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, load, materialize, slices

CELLS, TEMPER, HOST_WEIGHT, SUFFIX_WEIGHT, FAN_IN = 1 << 13, 60.0, 5.0, 20.0, 100
#: Most languages that are told apart: one array of counts of each goes to the driver.
LANGUAGES = 2000
#: Most hosts, suffixes or declarations whose sums are broadcast; beyond it the pages are shuffled to them.
BROADCAST_KEYS = 10_000
_BLOCK, _CLOSE = re.compile(rb"(?i)<(script|style|head)\b"), re.compile(rb"(?i)</(script|style|head)\s*>")
_ENTITY, _HTML = re.compile(rb"&[#\w]+;"), re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})")


def visible(html: str | None) -> bytes:
    """The text outside tags, scripts, styles, the head and comments; what is not closed counts as one tag. One pass over the page."""
    if html is None:
        return b""
    raw, out, at = html.encode("utf-8", "surrogatepass"), [], 0
    closed: dict[bytes, list[re.Match]] = {}
    for m in _CLOSE.finditer(raw):
        closed.setdefault(m[1].lower(), []).append(m)
    for found in closed.values():
        found.reverse()  # the next one is the last
    comment = 0  # where the next end of a comment is; -1: there is none
    while (i := raw.find(b"<", at)) >= 0:
        out.append(raw[at:i])
        end = -1
        if raw.startswith(b"<!--", i) and comment >= 0:
            comment = raw.find(b"-->", i + 4) if comment < i + 4 else comment
            end = comment + 3 if comment >= 0 else -1
        elif m := _BLOCK.match(raw, i):
            ends = closed.get(m[1].lower(), [])
            while ends and ends[-1].start() < m.end():
                ends.pop()
            end = ends[-1].end() if ends else -1
        if end < 0:
            end = raw.find(b">", i) + 1
            if not end:
                at = i
                break
        out.append(b" ")
        at = end
    return _ENTITY.sub(b" ", b"".join([*out, raw[at:]]))


def declared_language(html: str | None) -> str:
    """The first language that an html tag declares, in lower case; "" without one."""
    raw, until = (html or "").encode("utf-8", "surrogatepass"), -1
    for m in _HTML.finditer(raw):
        if m.start() >= until:
            until = raw.find(b">", m.end())
            until = len(raw) if until < 0 else until
            if found := _LANG.search(raw, m.end(), until):
                return found[1].decode().lower()
    return ""


def _cells(raw: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes; digits, signs and white space read as one space."""
    b = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, 32)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log P(trigram cell | language), from all documents with a language and a text."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(parts):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(CELLS, np.int64))
                sums[lang] += np.bincount(_cells(text.encode("utf-8", "surrogatepass")), minlength=CELLS)
        task = pa.array([TaskContext.get().partitionId()] * len(sums), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), task, pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "task", "counts"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS, np.int64)
        for c in g["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "task": [g["task"].iloc[0]], "counts": [total.tobytes()]})

    known = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where("lang is not null and text is not null")
    kind = "lang string, task long, counts binary"
    sums = batches(known).mapInArrow(count, kind)
    for _ in range(3):  # a tree: no group has more than FAN_IN arrays for up to FAN_IN ** 3 tasks
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("lang", "task").applyInPandas(add, kind)
    rows = sorted(sums.groupBy("lang").applyInPandas(add, kind).limit(LANGUAGES + 1).collect(), key=lambda r: r[0])
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float).reshape(len(rows), CELLS) + 0.5
    return [r[0] for r in rows], np.log(counts / counts.sum(1, keepdims=True))


def text_posteriors(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, suffix, declared, p_0 .. p_n: the text posterior of each language under equal priors."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(parts):
            declared, post = [], np.empty((part.num_rows, len(langs)))
            for i, html in enumerate(part.column("html").to_pylist()):
                declared.append(declared_language(html))
                cells = _cells(visible(html))
                like = model @ np.bincount(cells, minlength=CELLS)
                like = like / max(1.0, len(cells) / TEMPER)
                like = np.exp(like - like.max(initial=-np.inf)) if len(langs) else like
                post[i] = like / max(like.sum(), 1e-300)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("suffix"), pa.array(declared, pa.string()), *[pa.array(post[:, j].copy()) for j in range(len(langs))]], ["page_id", "host", "suffix", "declared", *[f"p_{j}" for j in range(len(langs))]])

    host = F.lower(F.coalesce(F.regexp_extract(pages["url"].cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), pages["html"].cast("string").alias("html")).withColumn("suffix", F.coalesce(F.element_at(F.split("host", r"\."), -1), F.lit("")))
    return batches(rows.select("page_id", "host", "suffix", "html"), 200).mapInArrow(run, "page_id long, host string, suffix string, declared string, " + ", ".join(f"p_{j} double" for j in range(len(langs))))


def identify(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, declared, lang (the likeliest, ties to the first in order), posterior, text_lang."""
    n = len(langs)
    if not n:
        return pages.select(pages["page_id"].cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("declared", "string"), ("lang", "string"), ("posterior", "double"), ("text_lang", "string"))])
    p = materialize(text_posteriors(pages, langs, model))
    sums = lambda by, mark: p.groupBy(by).agg(*[F.sum(f"p_{j}").alias(f"{mark}{j}") for j in range(n)])
    whole = p.agg(*[F.sum(f"p_{j}") for j in range(n)], F.count_distinct("declared")).first()
    total = [float(x or 0) for x in whole[:n]]
    kinds = max(1, whole[n])
    all_of = sum(total)
    joined = p
    for by, mark in (("host", "h_"), ("suffix", "s_"), ("declared", "d_")):
        few = materialize(sums(by, mark))
        joined = joined.join(F.broadcast(few) if few.count() <= BROADCAST_KEYS else few, by)
    own = lambda mark, j: F.greatest(F.col(f"{mark}{j}") - F.col(f"p_{j}"), F.lit(0.0))
    add = lambda cols: sum(cols[1:], cols[0])
    h_all, s_all = add([own("h_", j) for j in range(n)]), add([own("s_", j) for j in range(n)])
    for j in range(n):
        first = (total[j] + 1) / (all_of + n)
        suffix = (own("s_", j) + SUFFIX_WEIGHT * first) / (s_all + SUFFIX_WEIGHT)
        prior = (own("h_", j) + HOST_WEIGHT * suffix) / (h_all + HOST_WEIGHT)
        joined = joined.withColumn(f"l_{j}", F.log(F.greatest(F.col(f"p_{j}"), F.lit(1e-12))) + F.log((own("d_", j) + 0.5) / F.greatest(F.lit(total[j]) - F.col(f"p_{j}") + 0.5 * kinds, F.lit(0.5))) + F.log(prior))
    names = F.array(*[F.lit(x) for x in langs])
    scores = F.array(*[F.col(f"l_{j}") for j in range(n)])
    top = F.array_max(scores)
    pick = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.select("page_id", "host", "declared", pick(scores).alias("lang"), (1 / add([F.exp(F.col(f"l_{j}") - top) for j in range(n)])).alias("posterior"), pick(F.array(*[F.col(f"p_{j}") for j in range(n)])).alias("text_lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "pages"), *train(load(spark, sf_dir, "documents")))
