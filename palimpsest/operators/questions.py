"""What a question asks for, as columns: operators, relation, dates, quoted names, listed scopes, options, and whether it needs the whole evidence.

All of it is worked out inside the row by column functions. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that mark an operator, in their order; any of them, in the lower-cased text between blanks, is enough.
OPERATORS = {
    "absence_or_false_premise": [" no ", "not ", "none", "nothing", "without", "doesn't", "does not", "didn't", "did not", "false premise", "any of"],
    "temporal_change": ["before", "after", "between", "changed", "change from", "disappear", "appeared", "previous", "subsequent", "transition", "reverse"],
    "ordered_relation": ["immediately", "directly before", "directly after", "next to", "precede", "follow", "in order", "which order", "what order", "ordered", "sequence"],
    "procedure": ["how many action", "how many step", "steps", "actions", "procedure", "performed", "complete the task", "what did", "which action"],
    "comparison_or_conjunction": [" both ", " each ", "all of", "among", "compared", "difference", "which of", "which option", "two ", "multiple"],
}
# The words of a relation; the first one that has any counts.
RELATIONS = {
    "between": [" between "],
    "after": [" after "],
    "before": [" before "],
    "adjacent": [" next to ", " adjacent "],
    "ordered": [" in order ", " which order ", " what order ", " ordered ", " sequence "],
}
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_DATE = rf"(?i)\b(\d{{4}}-\d{{1,2}}-\d{{1,2}}|(?:{_MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?)\b"
_NONE = "array<string>"
# White space, the ends of a word and any character of a line, all as RE2 and other engines have them. Java's own classes differ by release: VT, the line
# separators and letters beyond ASCII.
_S, _NOT_S, _OPEN, _CLOSE, _ANY = r"[\t\n\f\r ]", r"[^\t\n\f\r ]", "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])", r"[^\n]"
_SEP = rf"/|,|{_OPEN}and{_CLOSE}|{_OPEN}or{_CLOSE}"


def _has_any(padded: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(padded, w))


def operators(padded: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(_has_any(padded, words), F.lit(name)) for name, words in OPERATORS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("fact_lookup")))


def relation(padded: Column) -> Column:
    return F.coalesce(*[F.when(_has_any(padded, words), F.lit(name)) for name, words in RELATIONS.items()], F.lit("none"))


def dates(text: Column) -> Column:
    """Dates in order of place, each once: year-month-day, and named months whose year, where it is left out, is that of all other named ones if they agree. Impossible dates are left out."""
    found = F.regexp_extract_all(text, F.lit(_DATE), F.lit(1))
    year = lambda x: F.regexp_extract(x, r"\s(\d{4})$", 1)
    years = F.array_distinct(F.filter(F.transform(found, year), lambda y: y != ""))
    inherited = F.when(F.size(years) == 1, F.try_element_at(years, F.lit(1)))
    part = lambda x, i: F.lpad(F.split_part(x, F.lit("-"), F.lit(i)), 2, "0")

    def of(x: Column, given: Column) -> Column:
        month = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(x, 1, 3))) + 2) / 3)
        named = F.concat_ws("-", F.coalesce(F.nullif(year(x), F.lit("")), given, F.lit("none")), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, r"\s(\d{1,2})", 1), 2, "0"))
        plain = F.concat_ws("-", F.split_part(x, F.lit("-"), F.lit(1)), part(x, 2), part(x, 3))
        return F.when(x.rlike(r"^\d"), plain).otherwise(named).try_cast("date")

    # zipped, so that no lambda works out the found dates again for each of them
    return F.array_distinct(F.array_compact(F.zip_with(found, F.array_repeat(inherited, F.size(found)), of)))


def lowered(x: Column) -> Column:
    """Lower case character by character: a capital sigma does not depend on its place, a dotted capital I gives one character."""
    return F.lower(F.translate(x, "Σİ", "σi"))


def squeezed(x: Column) -> Column:
    return F.regexp_replace(x, f"{_S}+", " ")


def trimmed(x: Column) -> Column:
    """Without the blanks of any script at both ends."""
    return F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")


def _first_of_each(items: Column, most: int) -> Column:
    """Items that differ but for case, the first of each, up to `most` of them; one pass."""
    start = F.array().cast(_NONE)
    add = lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: lowered(k) == lowered(x)), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(items, start, add)


def _listed(text: Column) -> Column:
    """The 2 to 12 items of a list with slashes, commas, `and` or `or`; else none."""
    cut = lambda x, pattern: F.regexp_replace(x, pattern, "")
    parts = F.split(cut(text, r"^[ .:;]+|[ .:;]+\z"), rf"(?i){_S}*(?:{_SEP}){_S}*")
    clean = F.transform(parts, lambda x: trimmed(cut(cut(trimmed(x), rf"(?i)^(?:the|the[sſ]e|tho[sſ]e|following){_S}+"), rf"(?i){_S}+(?:grid{_S}+table[sſ]?|table[sſ]?|form[sſ]?|option[sſ]?|item[sſ]?)\z")))
    kept = _first_of_each(F.filter(clean, lambda x: F.length(x).between(2, 80)), 13)
    return F.when(F.size(kept).between(2, 12), kept).otherwise(F.array().cast(_NONE))


def scopes(text: Column) -> Column:
    """Scopes that the text lists itself: in brackets with a slash or two commas, between double dashes, or after `among` or `across`; at most twelve, the first ones."""
    bracket = F.filter(F.regexp_extract_all(text, F.lit(r"\(([^()\n]{3,240})\)"), F.lit(1)), lambda x: F.contains(x, F.lit("/")) | (F.size(F.split(x, ",")) > 2))
    dashed = F.filter(F.regexp_extract_all(text, F.lit(rf"(?:--|—){_S}*({_ANY}{{3,200}}?){_S}*(?:--|—)"), F.lit(1)), lambda x: x.rlike(rf"(?i)(?:{_SEP})"))
    asked = "which|what|where|do|doe[sſ]|i[sſ]|are"
    among = F.regexp_extract(text, rf"(?i){_OPEN}(?:among|acro[sſ][sſ]){_S}+({_ANY}{{3,200}}?)(?=,{_S}*(?:{asked}){_CLOSE}|\?)", 1)
    among = F.when((among != "") & ~F.contains(among, F.lit("(")), F.array(among)).otherwise(F.array().cast(_NONE))
    return _first_of_each(F.flatten(F.transform(F.concat(bracket, dashed, among), lambda x: _listed(squeezed(x)))), 12)


def option_labels(text: Column) -> Column:
    """Labels A. to H. of a multiple choice, in capitals, each once; none if there are fewer than two. What stands between two labels is a text, not a label of its own."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|{_S})([A-H])\.{_S}+{_NOT_S}"), F.lit(1)), lambda x: F.upper(x))
    return F.when(F.size(found) > 1, F.array_distinct(found)).otherwise(F.array().cast(_NONE))


def straight_quoted(text: Column) -> Column:
    """Names in straight quotes, lower-cased, each once; blank ones are one name."""
    found = F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: trimmed(squeezed(lowered(x)))))


def quoted(text: Column) -> Column:
    """Names in straight or curly quotes or back ticks, lower-cased, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r'"([^"]+)"', r"`([^`]+)`", r"“([^”]+)”", r"‘([^’]+)’")])
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def profile(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, operators, relation, dates, quoted, scopes, options (labels), closed_world: whether absence, a relation, an ordinal, options, or scopes that are compared call for all evidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), F.lit(" "))
    out = rows.select(F.col(id_col), padded.alias("_p"), t.alias("_t"))
    out = out.select(id_col, "_p", operators(F.col("_p")).alias("operators"), relation(F.col("_p")).alias("relation"), dates(F.col("_t")).alias("dates"), quoted(F.col("_t")).alias("quoted"), scopes(F.col("_t")).alias("scopes"), option_labels(F.col("_t")).alias("options"))
    asks = lambda name: F.array_contains("operators", name)
    ordinal = F.col("_p").rlike(r"\b(?:first|second|third|fourth|last|another|additional)\b")
    closed = asks("absence_or_false_premise") | (F.col("relation") != "none") | ordinal | (F.size("options") > 0) | ((F.size("scopes") > 0) & asks("comparison_or_conjunction"))
    return out.withColumn("closed_world", closed).drop("_p")
