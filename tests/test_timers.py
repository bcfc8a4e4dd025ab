"""Review news of a stream: reviews in order, due words by timers, repeated and late rows."""

import collections
import datetime
import random

import pytest

from lexmill.functions import lexicon as L
from lexmill.operators import reviews
from lexmill.streaming import timers
from lexmill.streaming.reviews import step

START = datetime.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.needs_timers(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, batches):
    """News of batches of (word, day, id, quality); each batch is a file and a trigger."""
    schema = "word string, ts timestamp, id long, quality int"
    for i, rows in enumerate(batches):
        made = [(w, START + datetime.timedelta(days=d), n, q) for w, d, n, q in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={i:03}"))
    stream = spark.readStream.schema(schema + ", batch int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    news = timers.review_news(stream)
    query = news.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    query.stop()
    zero = int(spark.sql("SELECT unix_millis(timestamp'2025-01-01 00:00:00')").first()[0])
    return [(r.key, r.kind, (r.at - zero) / timers.DAY, r.id, r.ease, r.interval, r.reps) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def expected(rows, until):
    """Reviewed and due news of rows in order of event time, up to a day."""
    out, by = [], collections.defaultdict(list)
    for w, d, n, q in rows:
        by[w].append((d, n, q))
    for w, listed in by.items():
        state, due = (L.START_EASE, 0, 0), None
        for d, n, q in sorted(listed):
            if d > until:
                continue
            if due is not None and due <= d:
                out.append((w, "due", float(due), None, *state))
            state = step(*state, q)
            due = d + state[1]
            out.append((w, "reviewed", float(d), n, *state))
        if due is not None and due <= until:
            out.append((w, "due", float(due), None, *state))
    return sorted(out, key=str)


def test_stream_and_batch_agree(store, tmp_path):
    rnd = random.Random(1)
    rows = [(f"w{rnd.randint(0, 5)}", rnd.randint(0, 40) + rnd.randint(0, 9) / 16, i, rnd.randint(0, 5)) for i in range(60)]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 12] for i in range(0, 60, 12)]
    for b in batches:
        rnd.shuffle(b)  # out of order within what the watermark allows
    found = run(store, tmp_path, [*batches, [("end", 101.0, 999, 3)]])
    assert sorted((r for r in found if r[0] != "end"), key=str) == expected(rows, 100)
    last = {}
    for w, kind, at, _, ease, interval, reps in sorted(found, key=lambda r: r[2]):
        if kind == "reviewed":
            last[w] = ease, interval, reps
    table = store.createDataFrame([(w, d, i, q) for w, d, i, q in rows], "word string, at double, id long, quality int")
    assert {w: s for w, s in last.items() if w != "end"} == {r.word: (r.ease, r.interval, r.reps) for r in reviews.replay(table, "word", "at", "id").collect()}


def test_repeated_late_and_dropped_reviews(store, tmp_path):
    found = run(
        store,
        tmp_path,
        [
            [("a", 10, 1, 5), ("a", 10, 1, 5)],  # the same review twice while it waits
            [("b", 12, 2, 5)],  # moves the watermark to day 11
            [("a", 10, 1, 5)],  # again
            [("a", 14, 4, 4), ("c", 30, 5, 3)],
            [("a", 9.5, 3, 0), ("a", 14, 4, 4), (None, 31, 6, 3), ("c", 31, None, 3)],  # behind the watermark: dropped or told apart, never applied
        ],
    )
    mine = [r for r in found if r[0] == "a"]
    assert [r[1:4] for r in sorted(mine, key=lambda r: (r[2], str(r[1]))) if r[1] in ("reviewed", "due")] == [("reviewed", 10.0, 1), ("due", 11.0, None), ("reviewed", 14.0, 4), ("due", 20.0, None)]
    assert {r[1] for r in mine if r[3] in (1, 3, 4)} <= {"reviewed", "repeated", "late"}
    assert ("repeated", 10.0, 1) in [r[1:4] for r in mine]
    assert not [r for r in mine if r[3] == 3 and r[1] == "reviewed"]


def test_an_empty_stream_has_no_news(store, tmp_path):
    assert run(store, tmp_path, [[], [(None, 1, 1, 1)]]) == []


class Store:
    """A stand-in for a word's states that counts the calls."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "exists": lambda: self.value is not None,
                "get": lambda: self.value if self.value is not None else iter(self.rows),
                "update": lambda x: setattr(self, "value", x),
                "appendList": self.rows.extend,
                "put": lambda x: setattr(self, "rows", list(x)),
                "clear": lambda: setattr(self, "rows", []),
                "registerTimer": self.timers.append,
                "deleteTimer": self.timers.remove,
                "getValueState": lambda *_: self.states[0],
                "getListState": lambda *_: self.states[1 if self.calls < 3 else 2],
                "getMapState": lambda *_: pytest.fail("a map state costs a call for each review"),
            }[name](*args)

        return call


def test_calls_of_the_store_do_not_grow_with_a_words_reviews():
    handle, states = Store(), [Store(), Store(), Store()]
    handle.states = states
    words = timers.Words()
    words.init(handle)
    Review = collections.namedtuple("Review", "ms id quality")
    made = [Review(i * 1000, i, 5) for i in range(2000)]
    assert list(words.handleInputRows(("a",), iter(made), None)) == []
    assert handle.timers == [0]
    now = type("T", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
    news = list(words.handleExpiredTimer(("a",), now, None))
    assert [r.id for r in news if r.kind == "reviewed"] == list(range(2000))
    assert news[-1].interval == 2147483647
    assert sum(s.calls for s in (handle, *states)) < 30
