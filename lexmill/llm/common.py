"""Helpers shared by the operators: durable intermediate tables, table reading, Arrow row access."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes 0-9, a-z (A-Z folded) and everything beyond ASCII stay; the rest parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A-Z folded, nothing else changed.
FOLD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The words that WORD_BYTES makes, as a Java and RE2 pattern over folded text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there.

    Lost executors don't lose it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session may leave it unset and gets a temporary one.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def unclashed(docs: DataFrame, run: Callable[..., DataFrame], *names: str) -> DataFrame:
    """run(docs, *names) while the columns of docs have names that clash with none; its result has the columns of docs first."""
    columns = docs.columns
    plain = docs.toDF(*(f"__column{i}" for i in range(len(columns))))
    out = run(plain, *(f"__column{columns.index(n)}" for n in names))
    return out.toDF(*columns, *out.columns[len(columns) :])


def fold(column):
    """Lower-case A-Z only, unlike lower(), which folds all scripts."""
    return F.translate(column, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, by WORD_BYTES; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def blocks_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int, size: int, text: int) -> Iterator[list[tuple]]:
    """Rows in lists of at most `rows` rows and about `size` characters of the column at index `text`."""
    held, chars = [], 0
    for row in rows_of(batches, *names):
        held.append(row)
        chars += len(row[text] or "")
        if len(held) >= rows or chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held
