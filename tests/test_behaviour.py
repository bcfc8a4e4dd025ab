"""Facts about single operators on small literal inputs."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill import api
from lexmill.functions import expressions as X
from lexmill.operators import corpus, levels, ngrams, reviews, senses
from lexmill.operators.ranking import numbered
from lexmill.sources import readers


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


@pytest.mark.parametrize(("text", "expected"), [("42", True), (" 42 ", True), ("42 / 120", True), ("-42-", True), ("Page 7", True), ("vii", True), ("Population Genetics", False), ("Chapter 3", False), ("", False), (None, False)])
def test_page_number(spark, text, expected):
    assert values(spark, [(text,)], "s string", x=X.is_page_number("s")) == [(expected,)]


def test_examples(spark):
    rows = [(["Hello world.", "Hello world.", "42"],), (["Good [1] sentence", "  42  ", None, "Part 1"],)]
    out = values(spark, rows, "x array<string>", x=X.clean_examples("x"))
    assert out[0][0] == ["Hello world."]
    assert out[1][0] == ["Good sentence"]


def test_headers(spark):
    rows = [("b", i, "Population Genetics", str(11 + i), f"line {i}") for i in range(1, 4)] + [("c", 1, "One", "note a", ""), ("c", 2, "Two", "note b", "")]
    out = corpus.strip_headers(spark.createDataFrame(rows, "book string, page_no int, header string, footer string, body string")).orderBy("book", "page_no").collect()
    assert [(r.header, r.footer) for r in out] == [(None, None)] * 3 + [("One", "note a"), ("Two", "note b")]


def test_repeated_lines(spark):
    text = "\n".join(f"Population Genetics\n{12 + i}\nunique words {'abc'[i]}\nother text {'xyz'[i]}\n" for i in range(3))
    out = corpus.strip_repeated_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().text
    assert "Population" not in out and "12" not in out and out.count("unique") == 3 and out.count("other") == 3


LEMMAS = {
    "sciences": "science", "includes": "include", "boxes": "box", "churches": "church", "studies": "study", "making": "make", "worked": "work", "charging": "charge",
    "running": "run", "stopping": "stop", "walking": "walk", "calling": "call", "process": "process", "news": "news", "spring": "spring", "string": "string",
    "hundred": "hundred", "evening": "evening", "building": "building", "goes": "go", "does": "do", "has": "have",
}


def test_lemmas(spark):
    stems = ["make", "work", "charge", "run", "stop", "walk", "call"]
    rows = [(w, 10 + i) for i, w in enumerate(stems)] + [(w, 1000 + i) for i, w in enumerate(LEMMAS)]
    out = corpus.lemmas(spark.createDataFrame(rows, "word string, rank long"))
    assert {r.word: r.lemma for r in out.collect() if r.word in LEMMAS} == LEMMAS


def test_form_decisions(spark):
    rows = [("walked", "walk", "VERB", "VERB", {}), ("abandonment", "abandon", "NOUN", "VERB", {}), ("movement", "move", "NOUN", None, {}), ("phenomenon", "phenomenon", "NOUN", "NOUN", {"in_definition": "true"}), ("consciousness", "consciousness", "NOUN", "NOUN", {"freq": "8"}), ("simple", "simple", "ADJ", "ADJ", {})]
    made = X.form_decision("s", "l", "p", "lp", "c")
    out = values(spark, rows, "s string, l string, p string, lp string, c map<string,string>", i=made["independent"], t=made["term"])
    assert out == [(False, False), (True, False), (True, False), (True, True), (True, True), (False, False)]


def test_collocations(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta gamma"] * 3 + ["delta epsilon"] * 2)], "doc_id int, text string")
    assert {r.phrase for r in ngrams.collocations(docs, 2, 3).collect()} == {"alpha beta", "beta gamma"}
    assert ngrams.collocations(docs.limit(0)).count() == 0


def test_difficulty(spark):
    out = values(spark, [(7.73, 3.4, 5.5)], "a double, b double, c double", a=X.zipf_difficulty("a"), b=X.zipf_difficulty("b"), c=X.zipf_difficulty("c"), u=F.round(X.vocabulary_level(F.lit(3000)), 3), t1=X.tier(F.lit(0.05)), t5=X.tier(F.lit(0.5)), t9=X.tier(F.lit(0.95)))[0]
    assert out[0] < out[1] and out[2:] == (0.5, 0.176, 1, 5, 9)


def test_levels(spark):
    s = spark.createDataFrame([("ielts", 5.25), ("ielts", 6.5), ("nope", 1.0), (None, None)], "exam string, score double")
    assert [r.cefr for r in levels.level_of_score(s).collect()] == ["C2", "C1", "C2", "C2"]
    assert {r.exam: r.cefr for r in levels.learned_level(s).collect()}["ielts"] in ("A1", "B2")


def test_cap(spark):
    kept = spark.createDataFrame([(f"w{i}", 1, i / 100, "important" if i % 2 else "q") for i in range(20)], "word string, n int, q double, kept_by string")
    out = levels.capped(kept, 0.25).groupBy("kept_by").count().collect()
    assert {r.kept_by: r["count"] for r in out} == {"q": 10, "important": 5}


def test_senses(spark):
    rows = [("w", "same text here", f"s{i}", "en", i) for i in range(3)] + [("w", "a natural phenomenon", "a", "en", 5), ("w", "a natural phenomenon that is observable", "b", "en", 6), ("w", "to run", "a", "en", 7), ("w", "to run a program", "b", "en", 8), ("w", "中文", "a", "zh", 9), ("w", None, "a", "en", 10)]
    out = senses.merge_senses(spark.createDataFrame(rows, "word string, text string, source string, lang string, ord int")).orderBy("lang", "sense_no").collect()
    assert [(r.text, r.sources) for r in out] == [("same text here", ["s0", "s1", "s2"]), ("a natural phenomenon that is observable", ["a", "b"]), ("to run", ["a"]), ("to run a program", ["b"]), ("中文", ["a"])]


def test_reviews(spark):
    rows = [("w", i, 5) for i in range(6)] + [("x", 0, 5), ("x", 1, 2)]
    out = {r.word: r for r in reviews.replay(spark.createDataFrame(rows, "word string, day int, quality int"), "word", "day").collect()}
    assert (out["w"].ease, out["w"].interval, out["w"].reps) == (3.1, 390, 6)
    assert (out["x"].interval, out["x"].reps, out["x"].status) == (1, 0, "forgot")


def test_ipa(spark):
    out = values(spark, [(["L", "AY1", "F"],), (["K", "EY1", "AA2", "S"],)], "p array<string>", a=X.ipa("p"), b=X.ipa("p", False))
    assert out == [("/lˈaɪf/", "/lˈaɪf/"), ("/kˈeɪˌɑs/", "/kˌɑs/")]


def test_numbered(spark):
    out = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), "v").collect()
    assert all(r.n == r.v + 1 for r in out)
    assert numbered(spark.range(0).select(F.col("id").alias("v")), "v").count() == 0


def test_replies(spark):
    rows = [(["alpha", "beta"], 'x [{"headword":"Alpha","gloss_en":"first"},{"headword":"other"}] y'), (["c"], "garbage"), (["d"], None)]
    out = senses.parse_replies(spark.createDataFrame(rows, "words array<string>, reply string")).collect()
    assert [(r.word, r.gloss_en) for r in out] == [("alpha", "first")]


def test_readers(spark, tmp_path):
    (tmp_path / "cmu").write_text(";;; c\nLIFE  L AY1 F\nLIFE(2)  L AY2 F\n")
    (tmp_path / "cefr").write_text("headword,pos,CEFR,gloss\nability,noun,B1,power,He has, it\nability,noun,B2,power\n")
    (tmp_path / "wiki").write_text('{"word":"Run","pos":"verb","senses":[{"glosses":["go fast"],"topics":["b","a"]}],"sounds":[{},{"ipa":"/r/"}]}\nnot json\n')
    (tmp_path / "f1").write_text("one\ntwo\n")
    (tmp_path / "f2").write_text("two\n")
    assert readers.pronunciations(spark, str(tmp_path / "cmu")).first().phones == ["L", "AY2", "F"]
    assert readers.level_list(spark, str(tmp_path / "cefr")).first().cefr == "B2"
    w = readers.wiktionary(spark, str(tmp_path / "wiki")).collect()
    assert [(r.word, r.gloss_en, r.topics, r.ipa) for r in w] == [("run", "go fast", ["a", "b"], "/r/")]
    assert {r.word: r.band for r in readers.families(spark, [str(tmp_path / "f1"), str(tmp_path / "f2")]).collect()} == {"one": 1, "two": 2}


def test_contexts(spark):
    from lexmill.operators import enrich

    docs = spark.createDataFrame([(i, f"First {i} has alpha. Other one.\nalpha again here {i}!") for i in range(4)] + [(9, None)], "doc_id int, text string")
    words = spark.createDataFrame([("alpha",), ("other",), ("absent",)], "word string")
    found = {r.word: r.contexts for r in enrich.contexts(words, enrich.numbered_sentences(docs)).collect()}
    assert found == {"alpha": ["First 0 has alpha.", "alpha again here 0!", "First 1 has alpha."], "other": ["Other one."]}


def test_pages(spark, tmp_path):
    from lexmill.operators import reports

    rows = spark.createDataFrame([("b", "<p>2</p>"), ("A", "<p>1</p>")], "word string, html string")
    reports.write_text(reports.html_page(rows, "x < y"), str(tmp_path / "page"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "page")).collect())
    assert "x &lt; y" in text and text.index("1") < text.index("2")
    assert "</x" not in reports.json_page(spark.createDataFrame([("</x>",)], "v string")).first().html


def test_execute(spark):
    call = lambda n, **a: json.loads(api.execute(spark, n, a))
    assert call("clean_examples", examples=["a b", "42"])["examples"] == ["a b"]
    assert call("validate_entry", word="x")["missing"] == ["pos", "ipa", "gloss"]
    assert call("srs_review", quality=5)["state"]["interval"] == 1
    assert call("quantile_of", zipf=5.5)["q"] == 0.5
    assert len(call("srs_plan", words=["a", "b"])["plan"]) == 7
    assert not call("nope")["ok"]
    docs = spark.createDataFrame([(1, "serendipity watershed the the abandonment abandonment ran")], "doc_id int, text string")
    assert {"abandonment"} <= {w["word"] for w in call("generate_vocabulary", docs=docs, options={"u": 0.0})["words"]}


def test_stream(spark, tmp_path):
    from lexmill.streaming.reviews import review_states, windowed_counts

    source = str(tmp_path / "in")
    spark.createDataFrame(pd.DataFrame({"user_id": [1, 1, 2], "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-01"]), "quality": [5, 5, 1], "event_type": ["a", "a", "b"]})).write.parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp, quality long, event_type string").parquet(source)
    for name, df, mode in (("states", review_states(stream), "update"), ("counts", windowed_counts(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.user_id: (r.interval, r.reps) for r in spark.table("states").collect()} == {1: (6, 2), 2: (1, 0)}
    assert spark.table("counts").count() == 3


def test_registered_senses_are_whole_texts_in_bounded_groups(spark, tmp_path):
    from lexmill.plans import catalog

    start = "the same words open both of these senses and run on for more than sixty characters "
    texts = [start + "then rivers mountains valleys forests glaciers deserts oceans", start + "but engines turbines gearboxes pistons bearings crankshafts cylinders valves"]
    rows = [(i, t, "user", texts[i % 2]) for i in range(400) for t in (0, 8)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert max(r["count"] for r in catalog.sense_items(spark, str(tmp_path)).groupBy("word").count().collect()) <= 64
    assert {r.text for r in catalog.merge_senses(spark, str(tmp_path)).collect()} == set(texts)


def test_html_report_has_every_selected_entry(spark, tmp_path, monkeypatch):
    from lexmill.plans import catalog

    found = catalog.words
    monkeypatch.setattr(catalog, "words", lambda spark, d: found(spark, d).withColumn("zipf", F.lit(1.5)).withColumn("level", X.level_of_zipf("zipf")))
    letters = "bcdfghjklmnprstv"
    made = [f"{a}o{b}e{c}an" for a in letters for b in letters for c in letters][:1300]
    text = "\n".join(f"They saw {w} and {w} here." for w in made for _ in range(12))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = sorted(r.word for r in catalog.quantile_filter(spark, str(tmp_path)).collect())
    pages = catalog.html_report(spark, str(tmp_path)).orderBy("page").collect()
    assert len(kept) > 500 and len(pages) == -(-len(kept) // 500)
    assert re.findall(r"<b>([^<]*)</b>", "".join(r.html for r in pages)) == kept
