"""Grounding of claims in sources: the whole claim, or its sentence fragments one after the other.

Texts are compared in a normal form: full-width forms of ASCII as ASCII, lower case, without white space and punctuation. Sources are scanned once for each
block of claims (BLOCK claims or CHARS characters, whichever comes first) for the heads of claims and first fragments; what a head points at is then checked as a
whole. Nothing is cut off and no pair is made that shares no head.

Null and empty claims, and claims without a fragment of `least` characters, are grounded in nothing; so are rows without id. Repeated claims of one id are
claims of their own: the pair has the better mode, then the earlier place. Repeated source ids likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, CHARS = 50_000, 4_000_000
#: Where a claim may be cut into fragments, and what the normal form leaves out.
BREAK = r"[\r\n。！？；!?;]+"
SILENT = r"[\p{P}\p{Z}\s\x0B\x1C-\x1F\x{85}\x{FEFF}\x{FFFD}]+"
#: The printable ASCII characters as their full-width forms and as themselves.
WIDE, NARROW = "".join(chr(0xFEE0 + i) for i in range(33, 127)), "".join(map(chr, range(33, 127)))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW)), SILENT, "")


def fragments(text: Column, least: int = 8) -> Column:
    """The normal forms of the fragments of at least `least` characters, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), BREAK), lambda s: normal(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def _place(whole: str, pieces: list[str], source: str, least: int) -> tuple[str, int] | None:
    """The mode and the first place of a claim in a source; fragments are looked for after the end of the one before, the earliest place first."""
    at = source.find(whole) if len(whole) >= least else -1
    if at >= 0:
        return "whole", at
    end, first = 0, -1
    for piece in pieces:
        at = source.find(piece, end)
        if at < 0:
            return None
        first, end = at if first < 0 else first, at + len(piece)
    return ("fragments", first) if pieces else None


def _scan(block: list, least: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[str, set[int]] = {}
        for i, r in enumerate(block):
            for text in (r["whole"], *r["pieces"][:1]):
                if len(text) >= least:
                    heads.setdefault(text[:least], set()).add(i)
        automaton = ahocorasick.Automaton()
        for head, claims in heads.items():
            automaton.add_word(head, claims)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for source, text in zip(batch["source"], batch["text"], strict=True):
                met = set().union(*(claims for _, claims in automaton.iter(text))) if heads else set()
                for i in met:
                    found = _place(block[i]["whole"], block[i]["pieces"], text, least)
                    if found:
                        rows.append((block[i]["claim"], source, *found))
            yield pd.DataFrame(rows, columns=["claim", "source", "mode", "place"])

    return scan


def grounded(claims: DataFrame, sources: DataFrame, c_id: str, s_id: str, text: str, least: int = 8) -> DataFrame:
    """claim, source, mode (whole or fragments), place (of the first match in the source's normal form, from 0) of every claim and source that ground each other."""
    c = claims.where(F.col(c_id).isNotNull()).select(F.col(c_id).alias("claim"), normal(F.col(text)).alias("whole"), fragments(F.col(text), least).alias("pieces"))
    c = c.where((F.length("whole") >= least) | (F.size("pieces") > 0))
    s = sources.where(F.col(s_id).isNotNull()).select(F.col(s_id).alias("source"), normal(F.col(text)).alias("text")).where(F.length("text") >= least)
    n, chars = c.agg(F.count("*"), F.coalesce(F.sum(F.length("whole")), F.lit(0))).first()
    schema = f"claim {dict(c.dtypes)['claim']}, source {dict(s.dtypes)['source']}, mode string, place long"
    found = claims.sparkSession.createDataFrame([], schema)
    blocks = max(-(-n // BLOCK), -(-chars // CHARS))
    for i in range(blocks):
        block = c.where(F.pmod(F.xxhash64("claim", "whole"), F.lit(blocks)) == i).collect()
        found = found.union(s.mapInPandas(_scan(block, least), schema))
    best = F.min(F.struct((F.col("mode") != "whole").alias("worse"), "place", "mode")).alias("m")
    return found.groupBy("claim", "source").agg(best).select("claim", "source", "m.mode", "m.place")
