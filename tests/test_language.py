"""Tags and phrases by brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import phrases, tagging


@pytest.fixture(scope="module")
def treebank(spark):
    rnd = random.Random(2)
    words = {"D": ["the", "a"], "N": ["dog", "cat", "saw", "nation", "station"], "V": ["sees", "saw", "runs"], "A": ["big", "red"]}
    rows = []
    for s in range(200):
        shape = ["D", *(["A"] if rnd.random() < 0.5 else []), "N", "V", *(["D", "N"] if rnd.random() < 0.6 else [])]
        rows += [(s, i, rnd.choice(words[t]), t if rnd.random() < 0.95 else None) for i, t in enumerate(shape)]
    return spark.createDataFrame(rows, "sentence long, place int, token string, pos string")


def test_best_paths_by_enumeration(treebank):
    model = tagging.train(treebank)
    assert model.tags == ["A", "D", "N", "V"]
    rnd = random.Random(3)
    vocabulary = ["the", "a", "dog", "saw", "runs", "big", "creation", "zzz", "SAW"]
    sentences = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 6))] for _ in range(150)]

    def score(words, path):
        total = model.start[path[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(path))
        return total + sum(model.scores(w)[t] for w, t in zip(words, path, strict=True))

    for words, tags in zip(sentences, model.decode(sentences), strict=True):
        assert len(tags) == len(words)
        if words:
            best = max(score(words, p) for p in itertools.product(range(4), repeat=len(words)))
            assert score(words, [model.tags.index(t) for t in tags]) == best


def test_context_and_endings_decide(treebank):
    model = tagging.train(treebank)
    assert model.decode([["the", "saw", "saw", "the", "creation"]]) == [["D", "N", "V", "D", "N"]]
    assert (model.scores("creation") == model.keys["-tion"]).all()
    assert (model.scores("zzz") == 0).all()


def test_counts_are_the_training_rows(spark):
    rows = [(1, 0, "a", "D"), (1, 1, "b", "N"), (1, 2, "c", None), (1, 3, "b", "N"), (2, 0, "b", "N")]
    model = tagging.train(spark.createDataFrame(rows, "sentence long, place int, token string, pos string"), least=1)
    step = lambda n, all_: int(np.floor(0.5 + 1000 * np.log((n + 1) / (all_ + 2))))
    assert model.start.tolist() == [step(1, 2), step(1, 2)]
    assert model.step.tolist() == [[step(0, 1), step(1, 1)], [step(0, 0), step(0, 0)]]  # the gap breaks the succession
    assert set(model.keys) == {"=a", "-a", "=b", "-b"}


def test_tags_of_a_table_with_odd_rows(spark, treebank):
    rows = spark.createDataFrame([(1, ["the", "dog"], "x"), (2, [], "y"), (3, None, "z"), (4, ["the"] * 3000, "l")], "doc_id long, tokens array<string>, tags string")
    found = {r.doc_id: r.tags for r in tagging.tag(rows, tagging.train(treebank)).collect()}
    assert found[1] == ["D", "N"] and found[2] == [] and found[3] is None and len(found[4]) == 3000
    nothing = tagging.train(treebank.limit(0))
    assert {r.doc_id: r.tags for r in tagging.tag(rows, nothing).collect()}[1] == ["", ""]


def test_a_bounded_model_keeps_the_most_frequent_keys(treebank):
    model = tagging.train(treebank, most_keys=3)
    assert len(model.keys) == 3
    assert "=the" in model.keys or "-e" in model.keys


def test_seed_tags(spark):
    words = ["The", "station", "quickly", "walked", "ed", "and", "xyz", "sensible"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tagging.seed_tag(F.col("w")).alias("t")).collect()
    assert [r.t for r in rows] == ["DET", "NOUN", "ADV", "VERB", None, "CCONJ", None, "ADJ"]


# ---- phrases


def brute_words(text, listed):
    import re

    ws = re.findall(r"[A-Za-z']+", text.lower())
    out = []
    for p, k in listed:
        ps = re.findall(r"[A-Za-z']+", p.lower())
        out += [(p, k, i) for i in range(len(ws) - len(ps) + 1) if ps and ws[i : i + len(ps)] == ps]
    return out


LISTED = [("a b", "x"), ("a b", "y"), ("A  b", "z"), ("b", "x"), ("b a b", "x"), ("it's a", "x"), ("c c", "x"), ("...", "x"), ("", "x"), ("a b a b a", "q")]


def test_phrases_by_words_and_by_shuffle_equal_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["a", "b", "c", "A", "it's", "d.", "é"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None, "", "a b", "a b"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, phrase string, place int")
    table = spark.createDataFrame([*LISTED, (None, "x")], "phrase string, kind string")
    want = sorted((i, *m) for i, t in enumerate(texts) if t for m in brute_words(t, LISTED))
    for most in (phrases.MOST_PHRASES, 2):
        assert sorted(tuple(r) for r in phrases.find(docs, table, most=most).collect()) == want
    assert phrases.find(docs, table.limit(0)).count() == 0
    assert phrases.find(docs.limit(0), table).count() == 0


def test_phrases_by_characters_find_substrings(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abA é") for _ in range(rnd.randint(0, 40))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(LISTED[:8], "phrase string, kind string")
    want = []
    for i, t in enumerate(texts):
        for p, k in LISTED[:8]:
            low = (t or "").lower()
            want += [(i, p, k, j) for j in range(len(low)) if low.startswith(p.lower(), j)]
    for most in (phrases.MOST_PHRASES, 2):
        assert sorted(tuple(r) for r in phrases.find(docs, table, by="characters", most=most).collect()) == sorted(want)


def test_a_hundred_thousand_phrases_in_one_pass(spark):
    many = spark.range(100_000).select(F.concat(F.lit("w"), F.regexp_replace(F.hex("id"), "[0-9]", "x"), F.lit(" y w"), F.hex(F.col("id") % 7)).alias("phrase"), F.lit("k").alias("kind"))
    docs = spark.createDataFrame([(1, "so wAB y wB then wAB y w")], "doc_id long, text string")
    planted = spark.createDataFrame([("wab y wb", "k"), ("then wab", "k")], "phrase string, kind string")
    found = phrases.find(docs, many.unionAll(planted))
    assert {(r.phrase, r.place) for r in found.collect()} >= {("wab y wb", 1), ("then wab", 4)}
    assert found._jdf.queryExecution().toString().count("Exchange") == 0


def test_words_in_context(spark):
    docs = spark.createDataFrame([(1, "We break down here. Spring is far.\nNo more"), (2, "here. here. here. late we break down"), (3, None)], "doc_id long, text string")
    found = {r.word: r.kinds for r in phrases.words_in_context(docs, phrases.fixed_phrases(spark)).collect()}
    assert found == {"we": ["collocation"], "break": ["collocation"], "down": ["collocation"], "here": ["collocation"], "spring": ["polysemy"], "late": ["collocation"]}
    listed = phrases.phenomena(phrases.find(docs, phrases.fixed_phrases(spark))).collect()
    assert sorted((r.doc_id, r.polysemy, r.collocations, r.slang) for r in listed) == [(1, ["spring"], ["break down"], []), (2, [], ["break down"], [])]


def test_many_phrases_of_two_words_are_found_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The red Fox saw the red, red fox"), (2, "fox the"), (3, None), (4, ""), (5, "red"), (6, "fox's red fox")], "doc_id long, text string")
    table = spark.createDataFrame([("red fox", "book"), ("red fox", "slang"), ("the red", "book"), ("fox  the", "odd"), ("red", "polysemy"), ("saw the red", "slang"), ("fox the", None), ("red red", "book")], "phrase string, kind string")
    want = sorted(map(tuple, phrases.find(docs, table).collect()))
    assert (1, "red fox", "slang", 6) in want and (2, "fox  the", "odd", 0) in want and (6, "red fox", "book", 1) in want
    monkeypatch.setattr(phrases, "PAIRS_FROM", 1)
    monkeypatch.setattr(phrases, "MOST_ROWS", 2)
    for most in (phrases.MOST_PHRASES, 0):
        assert sorted(map(tuple, phrases.find(docs, table, most=most).collect())) == want
    assert "Exchange" not in phrases.find(docs, table.where("phrase in ('red fox', 'the red')"), most=0)._jdf.queryExecution().executedPlan().toString()
