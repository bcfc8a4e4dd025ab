"""Rendering, readers, repairs, registries and folds against plain Python on small inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill import api
from lexmill.functions import expressions as X
from lexmill.functions import rendering
from lexmill.operators import books, corpus, dictionaries, reports, reviews, senses
from lexmill.sources import readers


def test_unknown_field_fails_and_new_fields_register(spark, monkeypatch):
    with pytest.raises(KeyError):
        rendering.field("nope")
    monkeypatch.setitem(rendering.FIELDS, "size", lambda: F.length("word").cast("string"))
    assert spark.createDataFrame([("abc",)], "word string").select(rendering.field("size")).first().size == "3"


def test_incomplete_entries_are_not_rendered(spark):
    schema = "word string, ipa map<string,string>, gloss_zh string, gloss_en string"
    rows = [("a", {"en_us": "/a/"}, "", "g"), ("b", {}, "", "g"), ("c", {"en_us": "/c/"}, "", None), ("", {"en_us": "/d/"}, "", "g"), (None, None, None, None)]
    kept = spark.createDataFrame(rows, schema).where(rendering.is_complete()).collect()
    assert [r.word for r in kept] == ["a"]


def test_form_decision_reasons(spark):
    rows = [("walked", "walk", "VERB", "VERB", {}), ("abandonment", "abandon", "NOUN", "VERB", {"freq": "8", "italic": "true"}), ("Walks", "walk", "NOUN", "NOUN", {"in_heading": "true", "capitalized": "true", "tfidf": "0.6"}), ("", "x", "NOUN", None, None)]
    made = X.form_decision("s", "l", "p", "lp", "c")
    out = spark.createDataFrame(rows, "s string, l string, p string, lp string, c map<string,string>").select(made.alias("d")).select("d.*", X.entry_key("d").alias("key")).collect()
    assert [(r.independent, r.term, r.evidence, r.reason, r.key) for r in out] == [
        (False, False, [], "屈折变化", "walk"),
        (True, True, ["高频(8次)", "斜体（外来术语）"], "派生：POS VERB→NOUN", "abandonment"),
        (True, True, ["标题", "高TF-IDF", "句中大写（专名）"], "屈折变化；学术术语促进", "walks"),
        (False, False, [], "普通词", "x"),
    ]


def test_split_joined_words_by_brute_force(spark):
    rnd = random.Random(3)
    known = {w: i + 1 for i, w in enumerate(["the", "of", "cat", "dog", "house", "light", "light" + "house", "a", "in", "thec"])}
    words = ["lighthouse", "thecatinthehouse", "zzzzzzzzzz", "dogofthecat", "short", *("".join(rnd.choices(list(known), k=4)) for _ in range(40))]
    size = math.log(len(known) + 1)
    cost = lambda ws: sum(math.log(max(1, known[w]) * size) for w in ws)

    def splits(w):
        if not w:
            yield []
        for k in range(1, len(w) + 1):
            if w[:k] in known:
                yield from ([w[:k], *rest] for rest in splits(w[k:]))

    found = {r.word: r.parts for r in corpus.split_joined(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(known.items()), "word string, rank long")).collect()}
    for w in {w for w in words if len(w) >= 8}:
        best = min(map(cost, splits(w)), default=None)
        assert found[w] == [w] if best is None else "".join(found[w]) == w and cost(found[w]) == pytest.approx(best)
    assert "short" not in found and found["zzzzzzzzzz"] == ["zzzzzzzzzz"]


def test_similar_pairs_by_brute_force(spark):
    rnd = random.Random(4)
    sets = {i: sorted(set(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 9)))) for i in range(60)}
    for least in (0.2, 0.5, 1.0):
        found = {(r.a, r.b): r.jaccard for r in senses.similar_pairs(spark.createDataFrame(list(sets.items()), "item_id int, ts array<string>"), least).collect()}
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(sets.items(), 2)}
        assert found == pytest.approx({p: j for p, j in want.items() if j >= least})


def test_sense_merge_streams_words(spark):
    rows = [("w", t, s, "en", i) for i, (t, s) in enumerate([("same text", "a"), ("same text", "b"), ("same text", "c")])]
    rows += [("v", "a natural phenomenon", "a", "en", 0), ("v", "a natural phenomenon that is observable", "b", "en", 1), ("v", "quite other", "a", "en", 2), ("v", "中文", "a", "zh", 3), (None, "x y z", "a", None, 0)]
    out = {(r.word, r.lang, r.sense_no): (r.text, r.sources) for r in senses.merge_senses(spark.createDataFrame(rows, "word string, text string, source string, lang string, ord long")).collect()}
    assert out == {
        ("w", "en", 1): ("same text", ["a", "b", "c"]), ("v", "en", 1): ("a natural phenomenon that is observable", ["a", "b"]),
        ("v", "en", 2): ("quite other", ["a"]), ("v", "zh", 1): ("中文", ["a"]), (None, "en", 1): ("x y z", ["a"]),
    }


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "matrix.json").write_text('{"exams": {"ielts": {"bands": [{"min": 4.0, "max": 5.0, "cefr_max": "B1"}, {"min": 5.5, "max": 6.0, "cefr_max": "B2"}]}}}')
    assert sorted(tuple(r) for r in readers.level_bands(spark, str(tmp_path / "matrix.json")).collect()) == [("ielts", 4.0, 5.0, "B1"), ("ielts", 5.5, 6.0, "B2")]
    (tmp_path / "one.txt").write_bytes("café\nnaïve\n".encode("latin-1"))
    (tmp_path / "two.txt").write_text("café\nthe\n", encoding="utf-8")
    assert {r.word: r.band for r in readers.families(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")]).collect()} == {"café": 2, "naïve": 1, "the": 2}
    (tmp_path / "oxford.tsv").write_text("Able\tx\ty\tadj\ta2\nshort\tline\n")
    assert [tuple(r) for r in readers.tabbed_levels(spark, str(tmp_path / "oxford.tsv")).collect()] == [("able", "adj", "A2")]
    (tmp_path / "cmu.txt").write_text(";;; note\nWORD  " + " ".join(["AH0"] * 120) + "\nWORD(2)  W ER1 D\n")
    assert [tuple(r) for r in readers.pronunciations(spark, str(tmp_path / "cmu.txt")).collect()] == [("word", ["W", "ER1", "D"])]
    assert readers.subject_files(["physics", "phenomenology", "philosophy"]) == ["kaikki_topic_philosophy.jsonl", "kaikki_topic_physics.jsonl"]
    assert len(readers.subject_files(["nothing"])) == 7 == len(readers.subject_files([]))
    (tmp_path / "book.bin").write_bytes(b"one\ftwo")
    (tmp_path / "bad.bin").write_bytes(b"!")

    def pages(content):
        if content == b"!":
            raise ValueError("unreadable")
        return content.decode().split("\f")

    assert sorted(tuple(r)[1:] for r in readers.binary_documents(spark, f"{tmp_path}/*.bin", pages).collect()) == [(1, "one"), (2, "two")]
    blocks = [(1, 1, 0, 10.0, 1000.0, "head"), (1, 1, 2, 500.0, 1000.0, "b"), (1, 1, 1, 100.0, 1000.0, "a"), (1, 1, 3, 950.0, 1000.0, "foot")]
    zones = readers.page_zones(spark.createDataFrame(blocks, "doc_id int, page_no int, block_no int, y0 double, height double, text string")).first()
    assert (zones.header, zones.footer, zones.body) == ("head", "foot", "a\nb")


def test_repair(spark):
    rows = [("é sto-\nry",), ("  ",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    assert [r[0] for r in df.select(corpus.repair()).collect()] == ["é story", "  ", None]
    assert df.select(corpus.repair(lang="de")).first()[0] == "é sto-\nry"


def test_stated_titles_come_first(spark):
    row = spark.createDataFrame([("/x/Author - Book.pdf", "Mine", None), ("/x/Author - Book.pdf", "", "B")], "p string, t string, a string")
    assert [tuple(r[0]) for r in row.select(books.title_and_author("p", "t", "a")).collect()] == [("Mine", ""), ("Book", "")]


def test_one_review(spark):
    states = reviews.initial(spark.createDataFrame([("a",), ("b",), ("a",)], "word string"))
    after = {r.word: (r.ease, r.interval, r.reps, r.due) for r in reviews.review(states, "a", 5, 3).collect()}
    assert after == {"a": (2.6, 1, 1, 4), "b": (2.5, 0, 0, 0)}
    assert reviews.review(states, "zzz", 5, 3).exceptAll(states).count() == 0


def test_candidates_and_conflicts(spark):
    words = spark.createDataFrame([("cat", 1), ("xqz", 2), ("longer", 3)], "word string, n int")
    looked = spark.createDataFrame([("cat", "/kæt/", None, ""), ("xqz", " ", None, "")], "word string, ipa string, gloss_zh string, gloss_en string")
    assert {r.word for r in dictionaries.candidates(words, looked).collect()} == {"cat", "longer"}


def test_accessories_and_json(spark, tmp_path):
    words = spark.createDataFrame([("alpha", 5, "A1"), ("beta", 3, "B2")], "word string, n int, level string")
    phrases = spark.createDataFrame([("alpha beta", 3, 1.5)], "phrase string, n int, pmi double")
    made = reports.accessories(words, words.select("word", F.lit("an example").alias("example")), phrases, phrases, "T")
    assert len(made) == 6
    reports.write_text(made["短语句式统计.md"], str(tmp_path / "note"))
    assert "| 1 | alpha beta | 3 | 1.5 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "note")).collect())
    assert '"n":5' in reports.to_json(words).where("word = 'alpha'").first().json


def test_registries(spark, monkeypatch):
    monkeypatch.setattr(api, "LANGUAGES", set(api.LANGUAGES))
    assert api.register_language("it") and "it" in api.execute(spark, "list_languages")
    words = spark.createDataFrame([("a", 1, 5.0), ("cat", 9, 6.0), ("dog", 20, 2.0)], "word string, n int, zipf double")
    monkeypatch.setitem(api.PREDICATES, "short", lambda k: F.length("word") <= k)
    assert [r.word for r in api.keep(words, ("frequency", 2, 30), ("zipf_floor", 3.0)).collect()] == ["cat"]
    assert [r.word for r in api.keep(words, ("short", 1)).collect()] == ["a"] and api.keep(words).count() == 3
    api.inject(model=len)
    assert api.INJECTED["model"] is len
    api.reset()
    assert not any(api.INJECTED.values())
    assert api.call_schema("quantile_of")["parameters"]["properties"].keys() == {"zipf", "band", "level"}
    assert {"ipa", "morpheme"} <= set(api.ENRICHERS)


def test_stream_and_batch_reviews_agree(spark):
    from lexmill.streaming.reviews import step

    rows = [(e / 100, i, r, q) for e in (130, 185, 250, 333) for i in (0, 1, 6, 15, 45) for r in (0, 1, 2, 5) for q in range(-1, 7)]
    s = X.review_step("ease", "interval", "reps", "quality")
    for r in spark.createDataFrame(rows, "ease double, interval int, reps int, quality int").select("*", s.alias("s")).collect():
        ease, interval, reps = step(r.ease, r.interval, r.reps, r.quality)
        assert (r.s.interval, r.s.reps) == (interval, reps) and r.s.ease == pytest.approx(ease, abs=0.0101)
