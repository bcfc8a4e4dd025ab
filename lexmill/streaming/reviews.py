"""Review streams: the state of each word kept up to date, and counts in event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.functions import lexicon as L

QUALITY = {"purchase": 5, "signup": 4, "click": 3, "view": 2, "error": 1}


def step(ease: float, interval: int, reps: int, quality: int) -> tuple[float, int, int]:
    """One review, as review_step() of the batch expressions."""
    q = min(5, max(0, quality))
    if q >= 3:
        interval, reps = L.FIRST_INTERVALS[reps] if reps < 2 else min(L.LONGEST_INTERVAL, max(1, round(interval * ease))), reps + 1
    else:
        interval, reps = 1, 0
    return max(L.LEAST_EASE, round(ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 2)), interval, reps


def review_states(reviews: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """A row (key, ease, interval, reps) for each key of a micro-batch that had reviews (key, ts, quality); state is kept by Spark."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (L.START_EASE, 0, 0)
        for quality in pd.concat(frames).sort_values([time, "quality"])["quality"]:
            now = step(*now, int(quality))
        state.update(now)
        yield pd.DataFrame([(k[0], *now)], columns=[key, "ease", "interval", "reps"])

    return reviews.groupBy(key).applyInPandasWithState(update, f"{key} long, ease double, interval int, reps int", "ease double, interval int, reps int", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows of event time; rows later than `late` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
