"""The library in SQL: functions against the column expressions, table functions on odd tables."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexmill import sql
from lexmill.functions import expressions as X
from lexmill.operators import reviews


@pytest.fixture(scope="module")
def installed(spark):
    sql.install(spark)
    return spark


def test_scalar_functions_are_the_column_expressions(installed):
    rows = installed.createDataFrame(
        [(6.1, 2, "A1", "see [3] the d-\nog", 2.5, 6, 2, 4), (None, None, None, None, 1.3, 0, 0, 9), (0.0, 9, "Z", " 12 ", 2.0, 1, 1, -3), (3.3, None, "C2", "Chapter 1", 2.2, 40, 7, 3)],
        "zipf double, band int, level string, s string, ease double, interval int, reps int, quality int",
    )
    rows.createOrReplaceTempView("odd")
    found = installed.sql("SELECT lexmill_difficulty(zipf, band, level) AS d, lexmill_tier(zipf / 7) AS t, lexmill_level(zipf) AS l, lexmill_clean_example(s) AS c, lexmill_review(ease, interval, reps, quality) AS r, lexmill_missing_fields(s, level, null, ' ') AS m, lexmill_clean_examples(array(s, s, 'a')) AS xs FROM odd")
    want = rows.select(X.difficulty("zipf", "band", "level"), X.tier(F.col("zipf") / 7), X.level_of_zipf("zipf"), X.clean_example("s"), X.review_step("ease", "interval", "reps", "quality"))
    got = found.collect()
    for g, w in zip(got, want.collect(), strict=True):
        assert tuple(g)[:5] == tuple(w)
    assert [g.m for g in got] == [["ipa", "gloss"], ["word", "pos", "ipa", "gloss"], ["ipa", "gloss"], ["ipa", "gloss"]]
    assert [g.xs for g in got] == [["see the dog", "a"], ["a"], ["a"], ["a"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lexmill" not in plan and "PythonUDF" not in plan  # inlined


def test_ngrams_have_as_many_columns_as_asked(installed):
    installed.createDataFrame([("It's a b", 1), (None, 2), ("one", 3), ("", 4), ("a b c d", 5)], "text string, w1 int").createOrReplaceTempView("t")
    found = installed.sql("SELECT * FROM lexmill_ngrams(TABLE(t), 'text', 3)")
    assert found.columns == ["w1", "w2", "w3"]
    assert sorted(map(tuple, found.collect())) == [("a", "b", "c"), ("b", "c", "d"), ("it's", "a", "b")]
    for wrong in ("'nothing', 2", "'text', 0"):
        with pytest.raises(AnalysisException):
            installed.sql(f"SELECT * FROM lexmill_ngrams(TABLE(t), {wrong})").collect()


def test_replay_in_sql_is_the_batch_replay(installed):
    rows = installed.range(600).select((F.col("id") % 7).alias("key"), (F.col("id") * 31 % 101).alias("at"), (F.col("id") * 13 % 8 - 1).cast("int").alias("quality"), "id")
    rows.createOrReplaceTempView("r")
    found = installed.sql("SELECT * FROM lexmill_replay(TABLE(r) PARTITION BY key ORDER BY (at, id))").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, reviews.replay(rows, "key", "at", "id").collect()))
    assert installed.sql("SELECT * FROM lexmill_replay(TABLE(SELECT * FROM r WHERE false) PARTITION BY key ORDER BY (at))").count() == 0
    with pytest.raises(AnalysisException):
        installed.sql("SELECT * FROM lexmill_replay(TABLE(SELECT id FROM r) PARTITION BY id)").collect()


def test_look_up_is_one_join(spark):
    words = spark.createDataFrame([("dog",), ("cat",), ("none",)], "word string")
    d = {
        "cmu": spark.createDataFrame([("dog", ["D", "AO1", "G"])], "word string, phones array<string>"),
        "cefr": spark.createDataFrame([("dog", "noun", "A1", "an animal", "")], "word string, pos string, cefr string, gloss_en string, example string"),
        "oxford": spark.createDataFrame([("cat", "n", "A2")], "word string, pos string, cefr string"),
        "bilingual": spark.createDataFrame([("cat", "kat", "n. a pet", "猫", "n")], "word string, phonetic string, definition_en string, translation_zh string, pos string"),
        "wiki": spark.createDataFrame([("other", "x", "noun", None)], "word string, gloss_en string, pos string, etymology string"),
    }
    sql.install(spark, d, words)
    spark.createDataFrame([(1, " DOG "), (2, "cat"), (3, "zzz"), (4, None)], "k int, w string").createOrReplaceTempView("asked")
    found = {r.k: (r.word, r.gloss_en, r.level) for r in spark.sql("SELECT k, b.* FROM asked, LATERAL lexmill_lookup(w) b").collect()}
    assert found == {1: ("dog", "an animal", "A1"), 2: ("cat", "a pet", "A2")}
    assert {tuple(r) for r in spark.sql("SELECT * FROM lexmill_coverage()").collect()} == {("cmu", 1), ("cefr", 1), ("oxford", 1), ("bilingual", 1), ("wiki", 1)}


def test_review_days(installed):
    assert [r.day for r in installed.sql("SELECT day FROM lexmill_review_days(30)").collect()] == [0, 1, 7, 23]
    assert installed.sql("SELECT * FROM lexmill_review_days(0)").count() == 0
