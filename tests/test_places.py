"""Synthetic pages: one row for each text is put in order, not one for each token."""

import random

from lexmill.operators import corpus
from lexmill.sources import readers


def test_pages_of_places(spark):
    rnd = random.Random(4)
    texts = ["", None, "the of", *(" ".join(rnd.choice(["river", "the", "stone", "walked", "aaa", "of"]) for _ in range(rnd.randint(1, 40))) for _ in range(60))]
    ids = [rnd.choice([None, 1, 1, *range(2, 60)]) for _ in texts]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    lemma_of = spark.createDataFrame([("river", "river"), ("the", "the"), ("stone", "stone"), ("walked", "walk"), ("aaa", "aaa"), ("of", "of")], "word string, lemma string")
    clean = corpus.clean_tokens(readers.tokens(docs), lemma_of).collect()
    rows = sorted(((r.doc_id, r.pos) for r in clean), key=lambda x: (x[0] is None, x))
    places = corpus.clean_places(docs, lemma_of)
    plan = places._jdf.queryExecution().executedPlan().toString()
    tokens_at = plan.index("posexplode")
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")] and plan.index("BroadcastHashJoin") < tokens_at and "Exchange" not in plan[plan.index("BroadcastHashJoin") + 17 : tokens_at]
    got = corpus.paged_places(places, 7).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.pos, r.page_no) for r in got), key=key) == sorted(((i, p, k // 7 + 1) for k, (i, p) in enumerate(rows)), key=key)
    assert corpus.paged_places(corpus.clean_places(docs.limit(0), lemma_of)).count() == 0


def test_a_text_longer_than_a_batch_stays_one_row(spark):
    docs = spark.createDataFrame([(1, "stone " * 25_000), (2, "stone"), (3, "stone " * 10_000)], "doc_id long, text string").coalesce(1)
    lemma_of = spark.createDataFrame([("stone", "stone")], "word string, lemma string")
    assert sorted((r.doc_id, list(r.places) == list(range(len(r.places))), len(r.places)) for r in corpus.clean_places(docs, lemma_of).collect()) == [(1, True, 25_000), (2, True, 1), (3, True, 10_000)]
