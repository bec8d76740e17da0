"""Question profiles on single cases and odd texts."""

import datetime

from palimpsest.operators import questions as Q

DAY = datetime.date


def profiles(spark, *texts):
    got = Q.profile(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(texts)))
    return got


def test_dates_inherit_the_only_year(spark):
    got = profiles(spark, "March 3, 2021 and Apr. 5th, then 2020-1-2 and march 3 2021", "May 1, 2020 or May 2, 2021 or May 3", "May 3", "2021-02-30, 2021-2-3", "Sept 9th 2019 x2021-01-01", None)
    assert [r["dates"] for r in got] == [[DAY(2021, 3, 3), DAY(2021, 4, 5), DAY(2020, 1, 2)], [DAY(2020, 5, 1), DAY(2021, 5, 2)], [], [DAY(2021, 2, 3)], [DAY(2019, 9, 9)], []]


def test_scopes_are_lists_that_the_text_gives(spark):
    got = profiles(
        spark, "Which (the red tables / Blue, blue and green) is it?", "Is it (red, blue)?", "Of -- red, blue or green -- say", "Among the cats and dogs, which is it?",
        "across the board?", "(a/b)", "(red / red)", "(xx/yy) (yy/zz)", "", None)
    assert [r["scopes"] for r in got] == [["red", "Blue", "green"], [], ["red", "blue", "green"], ["cats", "dogs"], [], [], [], ["xx", "yy", "zz"], [], []]
    many = "(" + "/".join(f"n{i}" for i in range(12)) + ") (aa/bb)"
    assert profiles(spark, many)[0]["scopes"] == [f"n{i}" for i in range(12)] and profiles(spark, many.replace("n0", "n0/n99"))[0]["scopes"] == ["aa", "bb"]


def test_options_quotes_and_relation(spark):
    got = profiles(spark, 'Pick A. one b. two A. three of "Red  Fox", `x` and “red fox”', "Only A. one", "What is next to it after all", "plain", None)
    assert [r["options"] for r in got] == [["A", "B"], [], [], [], []]
    assert got[0]["quoted"] == ["red fox", "x"]
    assert [r["relation"] for r in got] == ["none", "none", "after", "none", "none"]
    assert got[2]["operators"] == ["temporal_change", "ordered_relation"] and got[3]["operators"] == got[4]["operators"] == ["fact_lookup"]
    assert [r["closed_world"] for r in got] == [True, False, True, False, False]


def test_closed_world(spark):
    got = profiles(spark, "the last page", "is there no page", "compare (red/blue) to both sides", "say (red/blue)")
    assert [r["closed_world"] for r in got] == [True, True, True, False]
    assert profiles(spark, "x")[0].asDict().keys() == {"id", "operators", "relation", "dates", "quoted", "scopes", "options", "closed_world"}


def test_long_texts_take_linear_time(spark):
    import time

    def seconds(n):
        text = " ".join(f"(ab{i}/cd{i}) on March {i % 28 + 1} A. x" for i in range(n))
        start = time.time()
        assert len(profiles(spark, text)[0]["scopes"]) == 12
        return time.time() - start

    seconds(10)
    assert seconds(8000) < 20


def test_scopes_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from palimpsest.plans import registry

    texts = [
        "Is `x` or “y” \"Z  z\" \" \" ' ", "A. B. C. D. x", "A. B. one\nC. two", "-- red\rfox, blue -- (aa/b\x0bb/cc )", "among the caféand, bb or cc?", "acroſſ red, the  blue, which iſ", "(red /　blue/ Red)",
        "(ΣΑΣ/σας/x y/İb/ib)", "(those\u0085aa/theſe bb/cc optionſ /dd items )", "éamong aa, bb?", "(aa/bb) café (cc /dd)", None, "", "(aa/bb)",
    ]
    rows = [(i if i < 13 else None, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["g8_scopes"](spark, str(tmp_path)).select("doc_id", "scopes", "options", "n_quoted").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(registry.SQL["g8_scopes"]).fetchall(), key=repr)
