"""Texts are cut into words once a scan, and one count serves all its readers."""

from lexmill.operators import corpus, ngrams, reports


def cuts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_ngram_scans_cut_a_text_once(spark):
    docs = spark.createDataFrame([("A b a b c",), ("x",), ("",), (None,), ("p q",), ("...",)], "text string")
    for n in (2, 3):
        assert cuts(ngrams.ngram_counts(docs, n)) == 1
    assert cuts(ngrams.placed_words(docs, 2)) == 1
    assert sorted((r.w1, r.w2, r.n) for r in ngrams.ngram_counts(docs, 2).collect()) == [("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("p", "q", 1)]
    assert sorted(r.w1 for r in ngrams.placed_words(docs, 2).collect()) == list("aabbcpq")
    assert sorted(r.w1 for r in ngrams.placed_words(docs, 1).collect()) == list("aabbcpqx")


def test_sentences_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "A b. 12! c\n\n- d"), (2, None)], "doc_id long, text string")
    found = reports.sentences(docs)
    assert cuts(found) == 1
    assert sorted((r.sentence, r.size) for r in found.collect()) == [("- d", 1), ("A b", 2), ("c", 1)]


def test_one_count_of_words_serves_a_collocation(spark):
    docs = spark.createDataFrame([("big red dog and big red dog",)] * 3, "text string")
    plan = ngrams.collocations(docs, 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    scans = [x for x in plan.split("\n") if "w1" in x and "Filter" in x and "greatest" in x]
    assert len(scans) == 4 and sum("isnotnull(w1" in x for x in scans) == 4


def test_documents_are_counted_where_they_are_read(spark):
    rows = [(1, "A a b"), (2, None), (3, "..."), (4, "x Y y"), (4, "y z"), (None, "q"), (None, "Q r"), (5, ""), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens, r.n_types) for r in corpus.document_sizes(docs).collect()} == {(1, 3, 2), (4, 5, 3), (None, 3, 2), (5, 1, 1)}
    unique = corpus.document_sizes(docs.where("doc_id = 1"))
    assert [(r.n_tokens, r.n_types) for r in unique.collect()] == [(3, 2)]
