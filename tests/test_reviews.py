"""Reviews at the ends of their ranges."""

from lexmill.functions import lexicon as L
from lexmill.operators import reviews
from lexmill.streaming.reviews import step


def test_a_long_run_of_good_reviews_ends_at_the_longest_interval(spark):
    table = spark.createDataFrame([("a", i, 5) for i in range(60)] + [("b", 0, 5)], "word string, at int, quality int")
    found = {r.word: (r.interval, r.reps) for r in reviews.replay(table, "word", "at").collect()}
    state = (L.START_EASE, 0, 0)
    for _ in range(60):
        state = step(*state, 5)
    assert found == {"a": (2147483647, 60), "b": (1, 1)}
    assert state[1:] == found["a"]
    after = reviews.review(spark.createDataFrame([("a", 2.5, 2147483647, 9, 0)], "word string, ease double, interval int, reps int, due int"), "a", 5, 100)
    assert after.first().due == 2147483647
