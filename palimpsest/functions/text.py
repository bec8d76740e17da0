"""Column functions over texts: tokens, words and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores, or one other visible character.
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
WORD = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def terms(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-cased words of more than `longer_than` characters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > longer_than))


def squeezed(text: Column) -> Column:
    """Lower-cased, with white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+", " "))


#: Scripts that put no blanks between words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_RUN = rf"([{_UNSPACED}]+|(?:[^\P{{L}}{_UNSPACED}]|\p{{N}}|_)+)"


def script_terms(text: Column) -> Column:
    """Lower-cased words of scripts with blanks, and the characters and pairs of neighbouring characters of runs of Han, Kana and Hangul; repeated ones stay."""

    def grown(run: Column) -> Column:
        chars = F.split(run, "")
        pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))
        return F.when(run.rlike(f"^[{_UNSPACED}]"), F.concat(chars, pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_RUN), F.lit(1)), grown))
