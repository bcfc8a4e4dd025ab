"""Composed forms: only texts that may change go to Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexmill import api
from lexmill.functions import expressions as X
from lexmill.operators import corpus


def test_composed_is_nfc_and_finds_all_texts_that_change(spark):
    rnd = random.Random(3)
    letters = ["a", "e", "ä", "̈", "́", "̣", "ᄀ", "ᅡ", "ᆨ", "가", "Å", "ཱ", "ི", "’", "中", "\U0001d15e", "\U0001d157", "\U0001d165", " "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 6))) for _ in range(3000)] + [None, "", "plain", "é", "x\ń"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", X.composed("t").alias("c"), F.col("t").rlike(X.uncomposed_pattern()).alias("sent")).collect()
    for r in rows:
        want = None if r.t is None else unicodedata.normalize("NFC", r.t)
        assert r.c == want and (r.t == want or r.sent), (r.t, r.c)
    assert not any(r.sent for r in rows if r.t in ("plain", "é", "’", ""))


def test_plain_texts_are_not_sent_and_words_are_counted_in_one_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The dogs walked. A dog walks café na-\nture"), (2, "dogs é"), (3, None)], "doc_id long, text string")
    scans = []
    kept = corpus.readers.tokens
    monkeypatch.setattr(api.readers, "tokens", lambda d, *a: scans.append(1) or kept(d, *a))
    monkeypatch.setattr(corpus, "clean_tokens", lambda *a: 1 / 0)  # every token once more, through an exchange
    found = {r.word: r.n for r in api.clean_words(docs).collect()}
    assert found["dog"] == 3 and found["caf"] == 1 and found["nature"] == 1 and len(scans) == 1
