"""The tagger's tasks: what they send and hold, against the plain forms."""

import itertools
import random

from lexmill.operators import tagging

WORDS = ["the", "The", "nation", "runs", "quickly", "xyz", "walked", "of", "over", "sing", "ed", "red", "family", "Äpfel", "don't", "business", "loving", "bly", "and", "NOT"]


def sentences(spark, n=300):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))]) for i in range(n)] + [(n, None), (n + 1, ["the"] * 900 + ["zzz"])]
    return spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)


def test_sure_tags_in_tasks_are_those_of_the_expression(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, "abction", "action", "tion", "xxxly", "xly", "visible", "best", "dresses"]], "w string")
    for r in rows.select("w", tagging.seed_tag("w").alias("t")).collect():
        assert tagging.seed_of(r.w) == r.t, r.w


def test_one_pass_trains_the_same_model(spark):
    given = sentences(spark)
    a, b = tagging.train_sentences(tagging.seeded(given)), tagging.train_seeded(given)
    assert a.tags == b.tags and (a.start == b.start).all() and (a.step == b.step).all()
    assert {k: v.tolist() for k, v in a.keys.items()} == {k: v.tolist() for k, v in b.keys.items()}


def test_counts_sent_are_those_of_all_tags_and_no_token_is(spark, monkeypatch):
    given = sentences(spark)
    model = tagging.train_seeded(given)
    tokens = tagging.tag(given, model)
    want = {(r.word, r.pos, r.n) for r in tagging.word_tags(tokens).collect()}
    counts = tagging.tag_counts(given, model)
    assert {(r.word, r.pos, r.n) for r in tagging.best_tags(counts).collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    parts = list(itertools.chain.from_iterable(tagging._coded(b.column(0), 50) for b in given.select("tokens").toArrow().to_batches()))
    assert all(len(codes) <= 50 or len(part) == 1 for part, _, codes, _ in parts) and sum(len(p[0]) for p in parts) == given.count()


def test_a_sentence_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "A b. 12! -\nc d")], "doc_id long, text string")
    found = tagging.tokens_by_sentence(docs)
    assert [r.tokens for r in found.orderBy("sentence").collect()] == [["A", "b"], ["c", "d"]]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_a_large_model_travels_as_one_table():
    model = tagging.Model(["A", "B"], {("^", "A"): 1}, {f"=w{i}": {"A": i} for i in range(1000)})
    assert model.table.shape == (1001, 2) and not [x for x in vars(model).values() if isinstance(x, dict) and any(hasattr(v, "dtype") for v in x.values())]
