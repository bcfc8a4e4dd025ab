"""First sentences of words: places are chosen in the tasks, sentences move once."""

from lexmill.operators import enrich


def words_of(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_places_are_cut_in_tasks(spark, monkeypatch):
    rows = [(i, 0, "Red apples again") for i in range(500)]
    sentences = spark.createDataFrame(rows, "doc_id long, no int, sentence string").repartition(2).selectExpr("*", "xxhash64(sentence) AS h")
    found = enrich.first_places(sentences)
    assert found.columns == ["word", "doc_id", "no", "h"]  # no sentence
    assert found.count() <= 2 * 3 * 3
    monkeypatch.setattr(enrich, "HELD", 1)
    full = {(r.word, r.doc_id) for r in enrich.first_places(sentences).collect()}
    assert {(w, i) for w in ("red", "apples", "again") for i in range(3)} <= full


def test_rows_without_an_id_come_last_and_equal_rows_count_once(spark):
    rows = [(None, 0, "Red of none"), (2, 0, "Red of two"), (2, 0, "Red of two"), (2, 0, "Red of two"), (2, 0, "two else"), (1, 4, "A red one"), (3, 1, "no such"), (None, 1, "Ärger red"), (None, 1, "blue")]
    sentences = spark.createDataFrame(rows, "doc_id long, no int, sentence string")
    found = {r.word: r.contexts for r in enrich.contexts(words_of(spark, "red", "two", "ärger", "missing"), sentences).collect()}
    assert found["red"] == ["A red one", "Red of two", "Red of none"]
    assert sorted(found["two"]) == ["Red of two", "two else"] and found["ärger"] == ["Ärger red"] and "missing" not in found


def test_a_text_is_cut_into_sentences_once(spark):
    docs = spark.createDataFrame([(1, "A b. c\n\nd"), (2, None)], "doc_id long, text string")
    found = enrich.numbered_sentences(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.doc_id, r.no, r.sentence) for r in found.collect()) == [(1, 0, "A b."), (1, 1, "c"), (1, 2, ""), (1, 3, "d"), (2, 0, "")]
