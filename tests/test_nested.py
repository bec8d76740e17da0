"""Nested records on odd rows: nulls, empties, missing keys, repeated texts, empty tables."""

from pyspark.sql import functions as F

from palimpsest.operators import nested as N

_RECORD = "id long, answer string, evidence string, ids array<string>, named array<string>, sessions array<array<struct<role:string,text:string,has_answer:boolean>>>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_field_by_kind(spark):
    kind = "id long, a string, b array<string>, c struct<x:int,y:string>, d map<string,int>, e int"
    df = spark.createDataFrame([(1, "  x ", ["z"], None, None, 1), (2, " ", ["a", None, "b", "c", "d", "e"], None, None, 1), (3, None, [], (1, None), None, 1), (4, "", None, None, {"k": 2}, 1), (5, "", [], None, {}, 1)], kind)
    got = df.select("id", N.first_field(df.schema, F.col, ["none", "a", "b", "c", "d", "e"]).alias("v"))
    assert rows(got) == [(1, "x"), (2, "a b c d"), (3, '{"x":1,"y":null}'), (4, '{"k":2}'), (5, None)]
    assert rows(df.select("id", N.first_field(df.schema, F.col, ["none"]).alias("v")).where("v is not null")) == []
    assert rows(df.select("id", N.first_answer(df, ["a", "b"]).alias("v"))) == [(1, "x"), (2, "a"), (3, None), (4, None), (5, None)]


def test_history_takes_the_first_key_with_messages(spark):
    kind = "id long, turns array<struct<speaker:string,text:string>>, said array<string>, note string"
    data = [(1, [("Ann", " hi "), (None, ""), ("", "yo")], ["no"], "n"), (2, [(None, " ")], ["", "b"], "n"), (3, None, None, " n "), (4, [], [None], " ")]
    got = N.history(spark.createDataFrame(data, kind), "id", ["turns", "said", "absent"], ["note"])
    assert rows(got) == [(1, 1, "Ann", "hi"), (1, 3, "user", "yo"), (2, 2, "user", "b"), (3, 1, "user", "n")]
    assert rows(N.history(spark.createDataFrame([], kind), "id", ["turns", "said"], ["note"])) == []


def test_sessions_run_on(spark):
    data = [(1, None, None, None, None, [[("user", "a", None), (None, " ", None)], None, [], [None, ("bot", " b", True)]]), (2, None, None, None, None, None)]
    assert rows(N.session_messages(spark.createDataFrame(data, _RECORD), "id", "sessions")) == [(1, 1, 1, "user", "a"), (1, 4, 2, "bot", "b")]


def test_evidence_by_precedence(spark):
    one, two = [("u", "Red fox", None), ("u", "cat", None)], [("u", "dog", None), ("u", "a red hen", None), ("u", "a red hen", None)]
    marked = [("u", "cat", True), ("u", "cat", True)]
    data = [
        (1, "red", " given ", ["s1"], ["s1"], [one, marked]),  # stated
        (2, "red", " ", ["s1", "s2"], ["s1"], [one, marked]),  # marked, once
        (3, "red", None, ["s1", "s2"], ["s1"], [one, two]),  # hits of the named session alone
        (4, "owl", None, ["s1", "s2"], ["s2"], [one, two]),  # no hit: the whole session
        (5, "RED", None, ["s1"], ["s9"], [one, two]),  # no session: any hit
        (6, None, None, None, None, [one]), (7, "owl", None, None, None, [one]), (8, "red", None, None, None, None),
    ]
    got = N.evidence(spark.createDataFrame(data, _RECORD), "id", "sessions", "ids", "named", ["answer"], ["evidence"])
    assert rows(got) == [(1, "explicit", 0, "given"), (2, "marked", 0, "cat"), (3, "session", 0, "Red fox"), (4, "session", 0, "dog"), (4, "session", 1, "a red hen"), (5, "answer", 0, "Red fox"), (5, "answer", 1, "a red hen")]


def test_histories_are_stored_once_and_come_back(spark):
    said = [(1, 1, "u", "a"), (1, 2, "b", None), (2, 2, "b", None), (2, 1, "u", "a"), (3, 1, "u", "a"), (4, 1, "b", None), (4, 2, "u", "a")]
    messages = spark.createDataFrame(said, "id long, turn int, role string, content string")
    refs = N.history_refs(messages, "id", "turn", "role", "content")
    by_id = {r["id"]: r["signature"] for r in refs.collect()}
    assert by_id[1] == by_id[2] and len(set(by_id.values())) == 3  # the same messages in other places are another history
    stored = N.stored_histories(messages, refs, "id")
    assert stored.count() == 5
    back = N.rehydrated(refs, stored, "id", ["turn", "role", "content"])
    assert rows(back.drop("verdict")) == sorted(said, key=repr) and {r["verdict"] for r in back.collect()} == {"ok"}
    lost = stored.where((F.col("signature") != by_id[3]) & ((F.col("signature") != by_id[4]) | (F.col("turn") == 1)))
    verdicts = {(r["id"], r["verdict"], r["turn"] is None) for r in N.rehydrated(refs, lost, "id", ["turn"]).collect()}
    assert verdicts == {(1, "ok", False), (2, "ok", False), (3, "missing", True), (4, "count", True)}
