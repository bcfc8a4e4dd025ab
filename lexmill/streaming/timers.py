"""Words as learners meet them: reviews applied in the order of their event time, and each word given out when it falls due.

Reviews wait in the state until the watermark has passed them, so a word's
history is replayed in order whatever order its reviews came in, and the
stream ends where a batch replay of the same rows ends. A timer at the due time
gives the word out unless a review comes before. Three kinds of odd rows are told apart:
a review with a number that was seen is repeated; one from before the last
applied review is late; one behind the watermark by more than a batch is
dropped and counted by Spark.

State of a word: four numbers, the reviews that wait for the watermark, and the
numbers of those applied within KEEP_DAYS, which timers clear.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.functions import lexicon as L
from lexmill.streaming.reviews import step

DAY = 86_400_000
KEEP_DAYS = 7
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWS = "key string, kind string, at long, id long, ease double, interval int, reps int"


class Words(StatefulProcessor):
    """News of a word: reviewed, due, repeated, late.

    A call reads and writes a word's lists once, however many reviews it has, and one timer stands for a word: at the
    first time at which something of it is to be done.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ease double, interval int, reps int, at long, due long, timer long")
        self.waiting = handle.getListState("waiting", "at long, id long, quality int")
        self.applied = handle.getListState("applied", "id long, at long")

    def read(self) -> tuple:
        return self.state.get() if self.state.exists() else (L.START_EASE, 0, 0, None, None, None)

    def write(self, ease: float, interval: int, reps: int, last: int | None, due: int | None, old: int | None, timer: int | None, fired: bool) -> None:
        """The state with its timer set to `timer`; a timer that fired is gone by itself."""
        if timer != old and old is not None and not fired:
            self.handle.deleteTimer(old)
        if timer is not None and (timer != old or fired):
            self.handle.registerTimer(timer)
        self.state.update((ease, interval, reps, last, due, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        ease, interval, reps, last, due, timer = self.read()
        applied = {number for number, _ in self.applied.get()}
        waiting = {(at, number) for at, number, _ in self.waiting.get()}
        new = []
        for r in rows:
            at, number = r.ms, r.id
            news = "repeated" if number in applied or (at, number) in waiting else "late" if last is not None and at < last else None
            if news:
                yield Row(key=key[0], kind=news, at=at, id=number, ease=None, interval=None, reps=None)
            else:
                waiting.add((at, number))
                new.append((at, number, r.quality))
        if new:
            self.waiting.appendList(new)
            first = min(new)[0]
            self.write(ease, interval, reps, last, due, timer, first if timer is None else min(first, timer), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        ease, interval, reps, last, due, timer = self.read()
        ready, rest = [], []
        for x in self.waiting.get():
            (ready if x[0] <= now else rest).append(tuple(x))
        applied = [tuple(x) for x in self.applied.get()]
        seen = len(applied)
        for at, number, quality in sorted(ready):
            if due is not None and due <= at:
                yield Row(key=key[0], kind="due", at=due, id=None, ease=ease, interval=interval, reps=reps)
            ease, interval, reps = step(ease, interval, reps, quality)
            last, due = at, at + interval * DAY
            applied.append((number, at))
            yield Row(key=key[0], kind="reviewed", at=at, id=number, ease=ease, interval=interval, reps=reps)
        if due is not None and due <= now:
            yield Row(key=key[0], kind="due", at=due, id=None, ease=ease, interval=interval, reps=reps)
            due = None
        kept = [x for x in applied if x[1] + KEEP_DAYS * DAY > now]
        if ready:
            _put(self.waiting, rest)
        if ready or len(kept) != seen:
            _put(self.applied, kept)
        times = [at for at, _, _ in rest] + [at + KEEP_DAYS * DAY for _, at in kept] + ([] if due is None else [due])
        self.write(ease, interval, reps, last, due, timer, min(times, default=None), True)

    def close(self) -> None:
        pass


def _put(held, rows: list[tuple]) -> None:
    if rows:
        held.put(rows)
    else:
        held.clear()


def needs_timers(spark: SparkSession) -> None:
    """Timers and several states of a key need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def review_news(reviews: DataFrame, key: str = "word", late: str = "1 day") -> DataFrame:
    """NEWS of a stream of reviews (key, ts, id, quality); at in milliseconds of event time. Times without a zone are UTC."""
    if dict(reviews.dtypes)["ts"] == "timestamp_ntz":
        reviews = reviews.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))
    rows = reviews.select(F.col(key).cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.unix_millis("ts").alias("ms"))
    kept = rows.where("key is not null and ts is not null and id is not null and quality is not null").withWatermark("ts", late)
    return kept.groupBy("key").transformWithState(Words(), NEWS, "append", "eventTime")
