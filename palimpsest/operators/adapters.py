"""Adapters: nested and loosely typed records to the tables of this library, and checks of what they hold.

Null fields count as missing. Nothing is collected: checks return rows with verdicts instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def tiered_evidence(rows: DataFrame, group: str, order: str, tiers: list[Column]) -> DataFrame:
    """group, order, tier: of each group the rows of the first tier (a condition) that any of its rows meets."""
    tier = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(tiers)])
    marked = rows.select(group, order, tier.alias("tier")).where("tier is not null")
    best = F.min("tier").over(Window.partitionBy(group))
    return marked.withColumn("best", best).where("tier = best").drop("best")


def haystack(questions: DataFrame, trajectories: DataFrame, q_id: str, ids: str, t_id: str, state: str) -> DataFrame:
    """question, place, trajectory, state, turn, verdict: each question's trajectories (an array of ids) in their places, with a running turn.

    A listed id without trajectory gives one row with the verdict missing; one that is listed twice is marked duplicate.
    """
    asked = questions.select(F.col(q_id).alias("question"), F.posexplode(ids).alias("place", "trajectory"))
    twice = F.count("*").over(Window.partitionBy("question", "trajectory")) > 1
    found = asked.withColumn("twice", twice).join(trajectories.select(F.col(t_id).alias("trajectory"), F.col(state).alias("state")), "trajectory", "left")
    verdict = F.when(F.col("state").isNull(), "missing").when(F.col("twice"), "duplicate").otherwise("ok")
    turn = F.row_number().over(Window.partitionBy("question").orderBy("place", "state")) - 1
    return found.select("question", "place", "trajectory", "state", turn.alias("turn"), verdict.alias("verdict"))


def trajectory_messages(states: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """group, turn, role, content: a header message (turn 0) and one message for each state, rendered from its place and kind."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    lines = states.select(group, turn.alias("turn"), F.lit("state").alias("role"), F.concat(F.lit("State "), turn.cast("string"), F.lit(": "), F.coalesce(kind, F.lit("?"))).alias("content"))
    head = states.groupBy(group).agg(F.count("*").alias("n"))
    head = head.select(group, F.lit(0).alias("turn"), F.lit("header").alias("role"), F.concat(F.lit("Trajectory of "), F.col("n").cast("string"), F.lit(" states")).alias("content"))
    return head.unionByName(lines)


def session_turns(rows: DataFrame, id_col: str, sessions: str) -> DataFrame:
    """id, session, dated, place, content from a map whose keys are session_N (arrays of texts) and session_N_date_time (one text)."""
    entry = rows.select(id_col, F.explode(F.map_entries(sessions)).alias("e")).select(id_col, "e.key", "e.value")
    number = F.regexp_extract("key", r"^session_(\d+)", 1).cast("int")
    dates = entry.where(F.col("key").rlike(r"^session_\d+_date_time$")).select(id_col, number.alias("session"), F.element_at("value", 1).alias("dated"))
    turns = entry.where(F.col("key").rlike(r"^session_\d+$")).select(id_col, number.alias("session"), F.posexplode("value").alias("place", "content"))
    return turns.join(dates, [id_col, "session"], "left")


def registry_check(rows: DataFrame, listed: DataFrame, id_col: str, subset: str) -> DataFrame:
    """subset, n, n_unlisted, n_repeated, complete: ids against a list (id, subset) of what each subset should hold."""
    seen = rows.groupBy(id_col, subset).agg(F.count("*").alias("times"))
    both = seen.join(listed.select(id_col, subset, F.lit(1).alias("listed")).distinct(), [id_col, subset], "full_outer")
    is_seen, is_listed = F.col("times").isNotNull(), F.col("listed").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    out = both.groupBy(subset).agg(count(is_seen).alias("n"), count(is_seen & ~is_listed).alias("n_unlisted"), count(F.col("times") > 1).alias("n_repeated"), count(is_listed & ~is_seen).alias("n_missing"))
    return out.withColumn("complete", (F.col("n_unlisted") == 0) & (F.col("n_missing") == 0) & (F.col("n_repeated") == 0))


def flattened_questions(docs: DataFrame, id_col: str, questions: str, options: str, label: str, kind: str) -> DataFrame:
    """id, place, question, gold: one row a question of a document; gold is the option of the label's index (from 0), null beyond it.

    Null queries are dropped: questions whose kind is null_query, and null or empty ones.
    """
    each = docs.select(id_col, options, label, kind, F.posexplode(questions).alias("place", "question"))
    each = each.where(f"coalesce({kind}, '') <> 'null_query' and coalesce(question, '') <> ''")
    return each.select(id_col, "place", "question", F.try_element_at(options, F.col(label).cast("int") + 1).alias("gold"))


def first_match(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose part occurs in the lower-cased text, in the listed order."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), None
    for part, name in rules:
        found = F.contains(lower, F.lit(part))
        out = F.when(found, name) if out is None else out.when(found, name)
    return F.lit(other) if out is None else out.otherwise(other)


def projected(rows: DataFrame, columns: list[str], meta: str, keys: list[str]) -> DataFrame:
    """The whitelisted columns, and the map `meta` with the whitelisted keys alone."""
    return rows.select(*columns, F.map_filter(meta, lambda k, _: k.isin(keys)).alias(meta))


def leaks(rows: DataFrame, id_col: str, forbidden: list[str]) -> DataFrame:
    """id, path: forbidden keys at any depth of structs, arrays and maps (lower case). The schema is walked on the driver, map keys in the data."""
    bad, out = [f.lower() for f in forbidden], None

    def walk(kind: DataType, path: str, value: Column) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in ([F.when(value[f.name].isNotNull(), F.array(F.lit(f"{path}.{f.name}"))).otherwise(F.array().cast("array<string>"))] if f.name.lower() in bad else []) + walk(f.dataType, f"{path}.{f.name}", value[f.name])]
        if isinstance(kind, MapType):
            hit = F.filter(F.map_keys(value), lambda k: F.lower(k.cast("string")).isin(bad))
            return [F.transform(F.coalesce(hit, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{path}."), k.cast("string")))]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, MapType):
            keys = F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda m: F.map_keys(m)))
            hit = F.array_distinct(F.filter(keys, lambda k: F.lower(k.cast("string")).isin(bad)))
            return [F.transform(hit, lambda k: F.concat(F.lit(f"{path}[]."), k.cast("string")))]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            names = [f.name for f in kind.elementType.fields if f.name.lower() in bad]
            return [F.when(F.size(value) > 0, F.array(*[F.lit(f"{path}[].{n}") for n in names])).otherwise(F.array().cast("array<string>"))] if names else []
        return []

    out = []
    for f in rows.schema.fields:
        if f.name.lower() in bad:
            out.append(F.when(F.col(f.name).isNotNull(), F.array(F.lit(f.name))).otherwise(F.array().cast("array<string>")))
        out += walk(f.dataType, f.name, F.col(f.name))
    found = F.flatten(F.array(*out)) if out else F.array().cast("array<string>")
    return rows.select(id_col, F.explode(found).alias("path"))


def normalised_events(events: DataFrame, speakers: DataFrame, id_col: str, speaker: str, dated: str, text: str, depends: str, most: int = 160) -> DataFrame:
    """id, speaker, dated, text, depends_on: speakers by case-folded lookup (name), of equal (speaker, date, text) the first,
    at most `most` a speaker, and only dependencies on rows that are left, other than the row itself."""
    names = speakers.select(F.lower(F.trim("name")).alias("k"), F.col("name").alias("canonical")).dropDuplicates(["k"])
    known = events.withColumn("k", F.lower(F.trim(speaker))).join(names, "k")
    known = known.select(id_col, F.col("canonical").alias("speaker"), F.col(dated).alias("dated"), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).alias("text"), F.col(depends).alias("depends_on"))
    first = known.withColumn("rn", F.row_number().over(Window.partitionBy("speaker", "dated", "text").orderBy(id_col))).where("rn = 1").drop("rn")
    left = first.withColumn("rn", F.row_number().over(Window.partitionBy("speaker").orderBy(id_col))).where(F.col("rn") <= most).drop("rn")
    ids = left.select(F.col(id_col).alias("depends_on"), F.lit(True).alias("there"))
    out = left.join(ids, "depends_on", "left")
    return out.select(id_col, "speaker", "dated", "text", F.when(F.col("there") & (F.col("depends_on") != F.col(id_col)), F.col("depends_on")).alias("depends_on"))


def instruction_parts(rows: DataFrame, id_col: str, text: str, schema: str) -> DataFrame:
    """id, api, request, parsed: the brace block after `API doc:` as a record of `schema`, and what follows `Request:`; absent parts are null."""
    block = F.nullif(F.regexp_extract(text, r"API doc:\s*(\{[^}]*\})", 1), F.lit(""))
    asked = F.nullif(F.trim(F.regexp_extract(text, r"Request:\s*(.*)$", 1)), F.lit(""))
    api = F.from_json(block, schema, {"allowSingleQuotes": "true"})
    return rows.select(id_col, api.alias("api"), asked.alias("request"), block.isNotNull().alias("parsed"))


def by_manifest(rows: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """place, id, verdict of each entry of the manifest (place, id): ok, unknown, repeated (listed before) or duplicate (several rows have it)."""
    seen = rows.groupBy(id_col).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("place"))
    listed = manifest.select("place", id_col, first.alias("nth")).join(seen, id_col, "left")
    verdict = F.when(F.col("n").isNull(), "unknown").when(F.col("nth") > 1, "repeated").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return listed.select("place", id_col, verdict.alias("verdict"))
