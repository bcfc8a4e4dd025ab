"""Spaced repetition: replay of reviews, due words, plans, latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.functions import lexicon as L


def initial(words: DataFrame, start: int = 0) -> DataFrame:
    return words.select("word").distinct().select("word", F.lit(L.START_EASE).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("reps"), F.lit(start).alias("due"))


def replay(reviews: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, ease, interval, reps, status, reviews) after all reviews (key, quality, order...) in order.

    A fold over each key's reviews, which are one array: as many as a learner makes, not as many as there are rows.
    """
    start = F.struct(F.lit(L.START_EASE).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("reps"), F.lit("new").alias("status"))
    in_order = F.array_sort(F.collect_list(F.struct(*order, "quality")))
    states = reviews.groupBy(key).agg(in_order.alias("rs"), F.count("*").alias("reviews"))
    return states.select(key, F.aggregate("rs", start, lambda s, r: X.review_step(s.ease, s.interval, s.reps, r.quality)).alias("s"), "reviews").select(key, "s.ease", "s.interval", "s.reps", "s.status", "reviews")


def due(states: DataFrame, day: int, as_text: bool = False) -> DataFrame:
    """Words due on a day. as_text compares the labels dayN as strings."""
    when = F.concat(F.lit("day"), F.col("due").cast("string")) <= f"day{day}" if as_text else F.col("due") <= day
    return states.where(when).select("word").orderBy("word")


def review(states: DataFrame, word: str, quality: int, day: int) -> DataFrame:
    """states (word, ease, interval, reps, due) after one review; unchanged if the word isn't among them."""
    s = X.review_step("ease", "interval", "reps", F.lit(quality))
    mine = F.col("word") == word
    new = {c: F.when(mine, s[c]).otherwise(F.col(c)).alias(c) for c in ("ease", "interval", "reps")}
    return states.select("word", *new.values(), F.when(mine, F.least(s["interval"].cast("long") + day, F.lit(L.LONGEST_INTERVAL)).cast("int")).otherwise(F.col("due")).alias("due"))


def cycle(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """(key, status, reps): events set a state or, with any other status, advance to the next of the cycle; words start as new.

    The last event that sets a state counts and the advances after it; no history is collected.
    """
    names = F.array(*map(F.lit, L.LEARNING_CYCLE))
    place = F.array_position(names, F.col(status))
    rows = events.select(key, F.struct(*order).alias("at"), F.when(place > 0, place - 1).alias("set"))
    last = rows.where("set is not null").groupBy(key).agg(F.max(F.struct("at", "set")).alias("last"))
    after = rows.join(last, key, "left").groupBy(key).agg(F.max("last.set").alias("set"), F.count(F.when(F.col("last").isNull() | (F.col("at") > F.col("last.at")), 1)).alias("steps"))
    state = F.element_at(names, ((F.coalesce("set", F.lit(0)) + F.col("steps")) % len(L.LEARNING_CYCLE) + 1).cast("int"))
    return after.select(key, state.alias("status")).withColumn("reps", F.when(F.col("status") == "new", 0).when(F.col("status") == "learning", 1).otherwise(3))


def plan(words: DataFrame, days: int = 7) -> DataFrame:
    """(day, words): how many words each day has when every review gets the best mark; all words share one schedule."""
    schedule, state, day = [], (L.START_EASE, 0, 0), 0
    while day < days:
        schedule.append(day)
        ease, interval, reps = state
        interval = L.FIRST_INTERVALS[reps] if reps < 2 else max(1, round(interval * ease))
        state, day = (round(ease + 0.1, 2), interval, reps + 1), day + interval
    n = words.agg(F.countDistinct("word").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"), "n").select("day", F.when(F.col("day").isin(*schedule), F.col("n")).otherwise(0).alias("words"))


def latest(events: DataFrame, key: str, status, *order: str) -> DataFrame:
    """(key, status): the last event wins."""
    return events.groupBy(key).agg(F.max_by(X.col(status), F.struct(*order)).alias("status"))
