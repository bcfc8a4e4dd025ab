"""Stored search index and stored replies."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import replies, search


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))), rnd.choice([None, "", "A gloss", "中文 ab", "ca%_"])) for _ in range(400)]
    rows += [("dup", "x"), ("dup", "x"), ("Ab", None)]
    path = str(tmp_path_factory.mktemp("index"))
    entries = spark.createDataFrame(rows, "word string, gloss string")
    old = search.BLOCK
    search.BLOCK = 50  # many blocks
    search.build(entries, path, ["word", "gloss"])
    yield rows, path
    search.BLOCK = old


@pytest.mark.parametrize("q", ["", "a", "ab", "abc", "é", "GLOSS", "中文", "文 a", "%_", "zzz", "cabac", "dup"])
def test_pages_of_a_search_by_brute_force(spark, index, q):
    rows, path = index
    want = sorted(((w, g) for w, g in rows if q.lower() in w.lower() or q.lower() in (g or "").lower()), key=lambda r: (r[0], r[1] is not None, r[1]))
    got, after = [], None
    while page := search.search(spark, path, ["word", "gloss"], q, after=after, size=90).collect():
        got += [(r.word, r.gloss) for r in page]
        after = page[-1].entry
    assert got == want
    assert search.count(spark, path, ["word", "gloss"], q) == len(want)


def test_a_search_reads_its_own_lists(spark, index):
    _, path = index
    plan = search.candidates(spark, path, "abca", 120)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram, [abc,bca])" in plan and "GreaterThanOrEqual(block,2)" in plan
    states = spark.createDataFrame([("dup", "mastered")], "word string, status string")
    found = search.search(spark, path, ["word"], "dup", states, "mastered").collect()
    assert [(r.word, r.status) for r in found] == [("dup", "mastered")] * 2
    assert search.search(spark, path, ["word"], "dup", states, "new").count() == 0


def model_in(folder, broken=""):
    """A model that leaves a file for each call; fails the first call for prompts with an f, always for prompts with the broken mark."""

    def ask(prompt):
        import os
        import uuid

        name = os.path.join(folder, prompt.replace(" ", "_") or "_")
        os.makedirs(name, exist_ok=True)
        before = len(os.listdir(name))
        open(os.path.join(name, uuid.uuid4().hex), "w").close()
        if broken and broken in prompt or ("f" in prompt and not before):
            raise RuntimeError("busy")
        return prompt.upper()

    return ask


def calls(folder):
    import os

    return {d: len(os.listdir(os.path.join(folder, d))) for d in os.listdir(folder)}


def test_a_failed_and_repeated_job_asks_each_prompt_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    prompts = spark.createDataFrame([(i, p, "old") for i, p in enumerate(["a", "b", "a", "f1", "x9", None, "c", ""])], "k int, prompt string, reply string")
    found = {r.k: (r.reply, r.error, r.tries) for r in replies.ask_once(prompts, model_in(str(log), "x"), store, pause=0.01).collect()}
    assert found == {0: ("A", None, 1), 1: ("B", None, 1), 2: ("A", None, 1), 3: ("F1", None, 2), 4: (None, "RuntimeError: busy", 3), 5: (None, None, None), 6: ("C", None, 1), 7: ("", None, 1)}
    again = {r.k: (r.reply, r.error) for r in replies.ask_once(prompts, model_in(str(log)), store, pause=0.01).collect()}
    assert again[4] == ("X9", None) and again[0] == ("A", None)
    counted = calls(log)
    assert counted["a"] == counted["b"] == counted["c"] == 1 and counted["f1"] == 2 and counted["x9"] == 4
    replies.gather(spark, store, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_a_task_that_is_run_again_goes_on_where_it_stopped(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    ask = model_in(str(log))

    def dying(prompt):
        import os

        if prompt == "p7" and not os.path.exists(str(log / "died")):
            open(str(log / "died"), "w").close()
            raise SystemExit(3)  # the worker goes down in the middle of a partition
        return ask(prompt)

    prompts = spark.range(20).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    with pytest.raises(Exception):  # noqa: B017 - local sessions don't run tasks again
        replies.ask_once(prompts, dying, store, pause=0.01)
    found = replies.ask_once(prompts, dying, store, pause=0.01).collect()
    assert sorted(r.reply for r in found) == sorted(f"P{i}" for i in range(20))
    (log / "died").unlink()
    assert set(calls(log).values()) == {1}


def test_a_budget_bounds_what_is_asked(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    prompts = spark.range(30).select(F.concat(F.lit("prompt number "), F.lpad(F.col("id").cast("string"), 2, "0")).alias("prompt"))  # 4 tokens each
    for most, done in ((40, 10), (3, 10), (41, 20), (None, 30)):
        replies.ask_once(prompts, model_in(str(log)), store, most, pause=0.01)
        assert len(calls(log)) == done
    assert set(calls(log).values()) == {1}


def test_files_grow_with_folders_and_not_with_prompts(spark, tmp_path):
    import os

    store = str(tmp_path / "store")
    prompts = spark.range(600).select(F.concat(F.lit("p\n\u2028é"), F.col("id").cast("string")).alias("prompt"))
    assert replies.ask_once(prompts, str.upper, store, pause=0.0).where("reply = upper(prompt)").count() == 600
    files = [os.path.join(at, f) for at, _, fs in os.walk(store) for f in fs]
    assert len([f for f in files if not os.path.basename(f).startswith(".")]) <= 256  # one of each task and folder
    assert not [f for f in files if f.endswith(".part")]


def test_a_torn_line_is_asked_again(spark, tmp_path):
    import glob

    store = str(tmp_path / "store")
    prompts = spark.range(40).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("prompt"))
    replies.ask_once(prompts, str.upper, store, pause=0.0)
    torn = sorted(glob.glob(f"{store}/*/*.json"))[0]
    whole = open(torn, "rb").read()
    lost = whole.rstrip(b"\n").rfind(b"\n") + 1
    open(torn, "wb").write(whole[: lost + 20])
    log = tmp_path / "log"
    log.mkdir()
    assert sorted(r.reply for r in replies.ask_once(prompts, model_in(str(log)), store, pause=0.0).collect()) == sorted(f"Q{i}" for i in range(40))
    assert list(calls(log).values()) == [1]
