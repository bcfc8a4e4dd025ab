"""Substring search over entries by a stored n-gram index, and pages by key.

build() writes two tables under a folder: entries, numbered in the order of
their words and sorted by number, and postings: for every one, two or three
characters in a row (gram) of the searched fields the sorted numbers of the entries that have it,
in blocks of BLOCK numbers, dealt to BUCKETS folders by the gram. A search reads the
lists of the query's grams only, from the block of the last key on, intersects them block by block,
fetches the entries that are left and verifies them. No list is longer than a block, whatever a gram's frequency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.ranking import durable, numbered

BUCKETS, BLOCK, LONGEST = 64, 65_536, 3


def folded(fields: list[str]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]


def grams_of(text: Column, n: int) -> Column:
    """Every n characters in a row, each once."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(entries: DataFrame, path: str, fields: list[str], key: str = "word") -> None:
    """Write the index of entries, searched in the fields, in the order of the key."""
    placed = numbered(entries, key, *(c for c in entries.columns if c != key), name="entry").withColumn("entry", F.col("entry") - 1)
    placed.sortWithinPartitions("entry").write.parquet(f"{path}/entries")
    held = reduce(F.array_union, (grams_of(c, n) for c in folded(fields) for n in range(1, LONGEST + 1)))
    lists = placed.select("entry", F.explode(held).alias("gram")).groupBy("gram", F.expr(f"entry div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    lists.withColumn("bucket", bucket(F.col("gram"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, q: str, first: int = 0) -> DataFrame:
    """(entry) of the entries from number `first` on that have every gram of q."""
    n = min(LONGEST, len(q))
    grams = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket(F.col("gram"))).distinct().collect()]
    lists = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & (F.col("block") >= first // BLOCK))
    both = lists.groupBy("block").agg(F.collect_list("entries").alias("held")).where(F.size("held") == len(grams))
    left = F.aggregate(F.slice("held", 2, len(grams)), F.get("held", F.lit(0)), lambda a, b: F.array_intersect(a, b)) if len(grams) > 1 else F.get("held", F.lit(0))
    return both.select(F.explode(left).alias("entry")).where(F.col("entry") >= first)


def search(spark: SparkSession, path: str, fields: list[str], q: str = "", states: DataFrame | None = None, status: str | None = None, after: int | None = None, size: int = 20, key: str = "word") -> DataFrame:
    """A page of entries that hold q in a field, in the order of the key, beyond entry number `after`, with the learning status (new where there is none).

    The entry column of a page's last row is `after` of the next page.
    """
    size, first, q = min(100, max(5, size)), 0 if after is None else after + 1, q.lower()
    found = spark.read.parquet(f"{path}/entries").where(F.col("entry") >= first)
    if q:
        verified = reduce(lambda a, b: a | b, (c.contains(q) for c in folded(fields)))
        found = found.join(candidates(spark, path, q, first), "entry").where(verified)
    if states is not None:
        found = found.join(states, key, "left").withColumn("status", F.coalesce("status", F.lit("new")))
        found = found.where(F.col("status") == status) if status else found
    return found.orderBy("entry").limit(size)


def count(spark: SparkSession, path: str, fields: list[str], q: str) -> int:
    """How many entries hold q."""
    entries = spark.read.parquet(f"{path}/entries")
    if not q:
        return entries.count()
    verified = reduce(lambda a, b: a | b, (c.contains(q.lower()) for c in folded(fields)))
    return entries.join(durable(candidates(spark, path, q.lower())), "entry").where(verified).count()
