"""Nested records: first non-empty fields of any kind, messages of flat and of session histories, evidence by precedence, histories stored once.

A nested record is one row, and what is taken from it is worked out inside that row: nothing is shuffled for it. Which keys exist and of what
kind they are is read from the schema; keys that it lacks are passed over. Null arrays, structs and maps count as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

_WHOLE = {"ignoreNullFields": "false"}


def _as_text(kind: DataType, value: Column) -> Column:
    """Trimmed text, null if there is none: of an array the first five elements joined, of structs and maps their JSON, of other kinds nothing."""
    if isinstance(kind, StringType):
        return F.nullif(F.trim(value), F.lit(""))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        cell = (lambda x: F.to_json(x, _WHOLE)) if isinstance(inner, (StructType, MapType, ArrayType)) else (lambda x: x.cast("string"))
        return F.when(F.size(value) > 0, F.array_join(F.transform(F.slice(value, 1, 5), cell), " "))
    if isinstance(kind, MapType):
        return F.when(F.size(value) > 0, F.to_json(value, _WHOLE))
    if isinstance(kind, StructType):
        return F.to_json(value, _WHOLE)
    return F.lit(None).cast("string")


def first_field(kind: StructType, get: Callable[[str], Column], keys: list[str]) -> Column:
    """The first key with a non-empty value, as text; null if none has one. Null elements of an array are left out."""
    found = [_as_text(kind[k].dataType, get(k)) for k in keys if k in kind.names]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def first_answer(rows: DataFrame, keys: list[str]) -> Column:
    """As `first_field`, but of an array its first element alone, and nothing of structs and maps."""
    found = []
    for k in (k for k in keys if k in rows.columns):
        kind = rows.schema[k].dataType
        if isinstance(kind, ArrayType):
            found.append(F.try_element_at(F.col(k), F.lit(1)).cast("string"))
        elif isinstance(kind, StringType):
            found.append(_as_text(kind, F.col(k)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


_CONTENT = ["content", "text", "utterance", "message"]
_MESSAGE = "array<struct<role:string,content:string,place:int>>"


def _message(kind: DataType, item: Column, before: Column) -> Column:
    """role, content and place, one more than the number of items before it."""
    if isinstance(kind, StructType):
        roles = [item[k].cast("string") for k in ("role", "speaker") if k in kind.names]
        role = F.coalesce(*[F.nullif(r, F.lit("")) for r in roles], F.lit("user")) if roles else F.lit("user")
        content = first_field(kind, lambda k: item[k], _CONTENT)
    else:
        role, content = F.lit("user"), F.nullif(F.trim(item.cast("string")), F.lit(""))
    return F.struct(role.alias("role"), content.alias("content"), (before + 1).cast("int").alias("place"))


def history(rows: DataFrame, id_col: str, keys: list[str], fallback: list[str]) -> DataFrame:
    """id, turn_index, role, content of the first key that holds messages: an array of texts or of structs, or one text.

    turn_index is the place in the array, from 1; empty messages leave their place free. Without any message the first non-empty field of
    `fallback` is one message of the user; without that the record gives no row.
    """
    options = []
    for k in (k for k in keys if k in rows.columns):
        kind = rows.schema[k].dataType
        if isinstance(kind, ArrayType):
            made = F.filter(F.transform(F.col(k), partial(_message, kind.elementType)), lambda m: m["content"].isNotNull())
        elif isinstance(kind, StringType):
            made = F.filter(F.array(_message(kind, F.col(k), F.lit(0))), lambda m: m["content"].isNotNull())
        else:
            continue
        options.append(F.when(F.size(made) > 0, made.cast(_MESSAGE)))
    last = F.filter(F.array(_message(StringType(), first_field(rows.schema, F.col, fallback), F.lit(0))), lambda m: m["content"].isNotNull())
    each = rows.select(F.col(id_col), F.explode(F.coalesce(*options, last.cast(_MESSAGE))).alias("_m"))
    return each.select(id_col, F.col("_m.place").alias("turn_index"), F.col("_m.role").alias("role"), F.col("_m.content").alias("content"))


def _turns(rows: DataFrame, sessions: str) -> Column:
    """Messages of all sessions in order, with the number of their session; null sessions and messages, and empty contents, are left out."""
    kind = rows.schema[sessions].dataType.elementType.elementType
    marked = lambda m: F.coalesce(m["has_answer"], F.lit(False)) if "has_answer" in kind.names else F.lit(False)

    def of_session(s: Column, i: Column) -> Column:
        made = F.transform(s, lambda m: F.struct((i + 1).cast("int").alias("session"), _message(kind, m, F.lit(0)).alias("m"), marked(m).alias("marked")))
        return F.filter(F.coalesce(made, F.array()), lambda m: m["m"]["content"].isNotNull())

    return F.flatten(F.transform(F.coalesce(F.col(sessions), F.array()), of_session))


def session_messages(rows: DataFrame, id_col: str, sessions: str) -> DataFrame:
    """id, session, turn_index, role, content of an array of sessions, each an array of message structs: turn_index runs on over the sessions, from 1, over the messages that have content."""
    each = rows.select(F.col(id_col), F.posexplode(_turns(rows, sessions)).alias("_p", "_t"))
    return each.select(id_col, F.col("_t.session").alias("session"), (F.col("_p") + 1).alias("turn_index"), F.col("_t.m.role").alias("role"), F.col("_t.m.content").alias("content"))


def evidence(rows: DataFrame, id_col: str, sessions: str, session_ids: str, answer_sessions: str, answers: list[str], explicit: list[str]) -> DataFrame:
    """id, place, tier, content: a record's evidence by precedence, each text once, in order from 0.

    Tiers: explicit (the first non-empty field of that name), marked (messages with has_answer), session (of each session that answer_sessions
    names the messages that hold the answer, or all of them if none does), answer (any message that holds it). Case does not count. A record
    without answer has no hits; one that no tier covers gives no row.
    """
    answer = F.lower(F.trim(F.coalesce(first_answer(rows, answers), F.lit(""))))
    none = F.array().cast("array<string>")
    said = rows.select(
        F.col(id_col), first_field(rows.schema, F.col, explicit).alias("_explicit"), answer.alias("_answer"), _turns(rows, sessions).alias("_turns"),
        F.coalesce(F.col(session_ids).cast("array<string>"), none).alias("_ids"), F.coalesce(F.col(answer_sessions).cast("array<string>"), none).alias("_named"),
    )
    holds = lambda t: (F.col("_answer") != "") & F.contains(F.lower(t["m"]["content"]), F.col("_answer"))
    named = F.filter("_turns", lambda t: F.coalesce(F.array_contains("_named", F.try_element_at("_ids", t["session"])), F.lit(False)))
    said = said.withColumn("_near", named).withColumn("_hits", F.filter("_near", holds))
    # zipped, so that the sessions with hits are worked out once
    with_hits = F.array_repeat(F.array_distinct(F.transform("_hits", lambda t: t["session"])), F.size("_near"))
    kept = F.zip_with("_near", with_hits, lambda t, s: F.when(holds(t) | ~F.array_contains(s, t["session"]), t))
    of_session = F.array_compact(kept)
    texts = lambda ts: F.array_distinct(F.transform(ts, lambda t: t["m"]["content"]))
    tiers = [
        ("explicit", F.when(F.col("_explicit").isNotNull(), F.array("_explicit")).otherwise(none)),
        ("marked", texts(F.filter("_turns", lambda t: t["marked"]))),
        ("session", texts(of_session)),
        ("answer", texts(F.filter("_turns", holds))),
    ]
    first = F.coalesce(*[F.when(F.size(c) > 0, F.struct(F.lit(name).alias("tier"), c.alias("texts"))) for name, c in tiers])
    found = said.select(id_col, first.alias("_f")).where("_f is not null")
    return found.select(id_col, F.col("_f.tier").alias("tier"), F.posexplode("_f.texts").alias("place", "content"))


def history_refs(messages: DataFrame, id_col: str, order: str, role: str, content: str) -> DataFrame:
    """id, signature, n_messages: records with the same messages in the same places share a signature.

    The signature is a sum of digests of (place, role, content), taken in two halves of 60 bits: partial sums meet, so no history is gathered
    into one row. Null roles and contents count as empty.
    """
    line = F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(content), F.lit(""))), 256)
    half = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = messages.groupBy(id_col).agg(half(1).alias("_a"), half(16).alias("_b"), F.count("*").alias("n_messages"))
    return sums.select(id_col, F.substring(F.sha2(F.concat_ws(":", "_a", "_b", F.col("n_messages").cast("string")), 256), 1, 20).alias("signature"), "n_messages")


def stored_histories(messages: DataFrame, refs: DataFrame, id_col: str) -> DataFrame:
    """signature and the messages' other columns: each history once, as its smallest id has it."""
    owners = refs.groupBy("signature").agg(F.min(id_col).alias(id_col))
    return messages.join(owners, id_col).drop(id_col)


def rehydrated(refs: DataFrame, stored: DataFrame, id_col: str, kept: list[str]) -> DataFrame:
    """id, verdict, and the stored columns `kept`: one row a message of every record whose store has the count that its reference states.

    A record without stored history has the verdict missing, one with another count the verdict count; both give one row with nulls.
    """
    sizes = stored.groupBy("signature").agg(F.count("*").alias("_size"))
    checked = refs.join(sizes, "signature", "left")
    verdict = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("n_messages"), "count").otherwise("ok")
    checked = checked.select(id_col, verdict.alias("verdict"), F.when(verdict == "ok", F.col("signature")).alias("signature"))
    return checked.join(stored.select("signature", *kept), "signature", "left").select(id_col, "verdict", *kept)
