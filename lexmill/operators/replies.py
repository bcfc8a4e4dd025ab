"""Model calls that are paid once: a store of replies by the hash of the prompt.

ask_once() answers prompts (prompt) from the store and asks the model only for
those that it lacks, each distinct prompt once. A task has one file for each folder of the store
and adds each reply to it before the next prompt is asked, so a task that is run again, or a job that failed and
is started again, goes on where it stopped; a line that a dying task left torn counts as not asked.
Where a file can be read only once it is closed (object stores), a task closes it and begins
another after ROLL seconds, and no more than those are asked again. Files grow with folders
and jobs, not with prompts. Prompts are dealt to folders by
their hash; the task of a folder reads what the folder holds before it asks.
Failing calls are repeated with growing pauses; what fails to the end is kept
with its error and asked again by the next job. A budget of tokens bounds what a job may ask.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ranking import durable

#: Hexadecimal digits of the hash that name a folder; tries of a call and the first pause in seconds; characters of a token.
DIGITS, TRIES, PAUSE, TOKEN_CHARS = 2, 3, 1.0, 4
#: Seconds after which a file is closed where open ones can't be read.
ROLL = 5.0
SCHEMA = "hash string, prompt string, reply string, error string, tries int"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def stored(spark, path: str) -> DataFrame:
    """(hash, prompt, reply, error, tries): the last word on each prompt of the store, a reply before an error."""
    system, inner = _folder(path)
    if not [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)) if f.is_file]:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path).where("hash is not null")
    return rows.groupBy("hash").agg(F.max_by(F.struct("prompt", "reply", "error", "tries"), F.struct(F.col("reply").isNotNull(), "tries")).alias("x")).select("hash", "x.*")


def within_budget(prompts: DataFrame, tokens: int) -> DataFrame:
    """Of (hash, prompt) those whose tokens, summed in the order of the hash, stay within the budget.

    Sums are made per range partition and shifted by those before it, one row a partition.
    """
    sized = durable(prompts.withColumn("tokens", F.ceil(F.length("prompt") / TOKEN_CHARS)).repartitionByRange("hash").sortWithinPartitions("hash").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sized.groupBy("part").agg(F.sum("tokens").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift"))
    running = F.sum("tokens").over(Window.partitionBy("part").orderBy("hash"))
    return sized.withColumn("run", running).join(F.broadcast(shifts), "part").where(F.col("run") + F.col("shift") <= tokens).select("hash", "prompt")


def ask_once(prompts: DataFrame, model: Callable[[str], str], path: str, tokens: int | None = None, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """prompts (prompt, ...) with reply, error and tries; all null for prompts beyond the budget. A null prompt is not asked."""
    spark = prompts.sparkSession
    given = prompts.withColumn("__hash", F.sha2(F.col("prompt").cast("binary"), 256))
    wanted = given.where("prompt is not null").select(F.col("__hash").alias("hash"), "prompt").dropDuplicates(["hash"])
    open_ = wanted.join(stored(spark, path).where("reply is not null").select("hash"), "hash", "left_anti")
    if tokens is not None:
        open_ = within_budget(open_, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _folder(path)
        known: dict[str, set[str]] = {}
        log = None
        asked = 0
        try:
            for batch in batches:
                for key, prompt in zip(batch.column("hash").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                    place = f"{inner}/{key[:DIGITS]}"
                    if place not in known:
                        if log is not None:
                            log.close()
                        known, log = {place: answered(system, place)}, Log(system, place)
                    if key in known[place]:
                        continue
                    reply = error = None
                    n = 0
                    while reply is None and n < tries:
                        n += 1
                        try:
                            reply, error = model(prompt), None
                        except Exception as e:  # noqa: BLE001 - whatever a client raises; kept with the prompt
                            error = f"{type(e).__name__}: {e}"
                            if n < tries:
                                time.sleep(pause * 2 ** (n - 1))
                    asked += 1
                    log.add({"hash": key, "prompt": prompt, "reply": reply, "error": error, "tries": n})
                    known[place].add(key)
        finally:
            if log is not None:
                log.close()
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["asked"])

    dealt = open_.withColumn("folder", F.substring("hash", 1, DIGITS)).repartition("folder").sortWithinPartitions("folder", "hash").select("hash", "prompt")
    dealt.mapInArrow(run, "asked long").agg(F.sum("asked")).collect()
    answers = stored(spark, path).select(F.col("hash").alias("__hash"), "reply", "error", "tries")
    return given.drop("reply", "error", "tries").join(answers, "__hash", "left").drop("__hash")


def answered(system: fs.FileSystem, place: str) -> set[str]:
    """Hashes of the prompts that a folder has replies of."""
    out = set()
    for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if f.is_file and f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as stream, io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n") as lines:
                for line in lines:
                    try:
                        row = json.loads(line)
                    except ValueError:  # torn
                        continue
                    if row.get("reply") is not None:
                        out.add(row["hash"])
    return out


class Log:
    """A task's file in a folder of the store, made with its first row; each row can be read as soon as it is added."""

    def __init__(self, system: fs.FileSystem, place: str):
        self.system, self.place, self.stream, self.began = system, place, None, 0.0

    def add(self, row: dict) -> None:
        if self.stream is None:
            self.system.create_dir(self.place, recursive=True)
            self.stream, self.began = self.system.open_output_stream(f"{self.place}/{uuid.uuid4().hex}.json"), time.monotonic()
        self.stream.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
        self.stream.flush()
        if not isinstance(self.system, fs.LocalFileSystem) and time.monotonic() - self.began > ROLL:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def gather(spark, path: str, into: str) -> None:
    """Write the store as one table at another place; the store's files can go then."""
    stored(spark, path).write.parquet(into)
