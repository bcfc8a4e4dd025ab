"""Histogram sort: exact byte counts below candidate boundaries find the shard splitters, then rows are exchanged once.

Rows are ordered by (hash of the text, hash of the id, row number), so equal
texts stand together. A splitter starts as the whole key range. In each round
the bytes and rows below 8192 candidate boundaries inside every splitter's range
are counted exactly, across all partitions at once; the candidate range that the
splitter's target falls into becomes its next range. A splitter stops at the
first boundary within `tolerance` of a shard's ideal size. A group of equal
texts is cut only when it holds more than `group_share` of a shard and a
boundary beside it is not near enough; so a group that holds a third of all
rows spreads over shards, and small groups stay whole.

The driver holds at most 8192 counts for each splitter. The rows (keys and
sizes, no texts) are exchanged once, by ranges of the key, and sorted; a shard's
slots follow that order. A row's slot is its place among its partition's rows of
the shard plus what earlier partitions hold of it, so no task numbers a whole
shard; these counts are a row for each partition and shard that meet.

Contract for odd rows: a null text has size 1 and crc 0, an empty one too; a text
of any size is one row and never parted; repeated rows are placed one by one, in
the order of their row numbers; a null doc_id is a value like any other; other
columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import durable, table

KEYS = ("k0", "k1", "k2")
#: Digits of a 63-bit key from the top: shift and width.
DIGITS = ((50, 13), (37, 13), (24, 13), (11, 13), (0, 11))
TOLERANCE, GROUP_SHARE = 0.005, 0.02
#: The row's place in a number of monotonically_increasing_id(), below that of its partition.
PLACE_BITS = 33


class Splitter:
    """A range of the key space that holds the target: prefix values of the keys and how far they are fixed."""

    def __init__(self, target: float):
        self.target, self.values, self.below, self.step, self.done = target, [0, 0, 0], 0, 0, False

    @property
    def place(self) -> tuple[int, int, int]:
        """The key and the digit that the next round counts: index of the key, shift, width."""
        return (self.step // len(DIGITS), *DIGITS[self.step % len(DIGITS)])

    def range(self) -> tuple:
        return self.step, tuple(self.values)

    def holds(self) -> Column:
        """Whether a row is in the range."""
        key, shift, width = self.place
        found = F.lit(True)
        for i in range(key):
            found &= F.col(KEYS[i]) == self.values[i]
        if self.step % len(DIGITS):
            found &= F.shiftrightunsigned(KEYS[key], shift + width) == self.values[key] >> (shift + width)
        return found

    def refine(self, counts: dict[int, tuple[int, int]], near: float, most_group: float) -> None:
        """Go into the candidate range that holds the target, or stop at one of its boundaries."""
        key, shift, _ = self.place
        at = self.below
        for digit in sorted(counts):
            size, rows = counts[digit]
            if at + size > self.target or digit == max(counts):
                break
            at += size
        low, high = self.target - at, at + size - self.target
        whole = shift == 0 and key == 0  # the range is one group of equal texts
        last = rows == 1 or (shift == 0 and key == 2)
        if min(abs(low), abs(high)) <= near or last or (whole and size <= most_group):
            self.values[key] += (digit + (abs(high) < abs(low))) << shift
            self.done = True
            for i in range(key, 0, -1):  # past the last value of a key: the next value of the one before it
                if self.values[i] >> 63:
                    self.values[i], self.values[i - 1] = 0, self.values[i - 1] + 1
        else:
            self.values[key] += digit << shift
            self.below, self.step = at, self.step + 1

    def before(self) -> Column:
        """Whether the splitter is at or before a row."""
        a, b, c = (F.col(k) for k in KEYS)
        x, y, z = self.values
        if x >> 63:  # past every row
            return F.lit(False)
        return (a > x) | ((a == x) & ((b > y) | ((b == y) & (c >= z))))


def find_splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE) -> list[Splitter]:
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    splitters = [Splitter(total * j / shards) for j in range(1, shards)]
    while total and (open_ := [s for s in splitters if not s.done]):
        ranges = {s.range(): s for s in open_}
        which, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, s in enumerate(ranges.values()):
            key, shift, width = s.place
            which = F.when(s.holds(), i).otherwise(which)
            digit = F.when(s.holds(), F.shiftrightunsigned(KEYS[key], shift).bitwiseAND(F.lit((1 << width) - 1))).otherwise(digit)
        counted: dict[int, dict] = {i: {} for i in range(len(ranges))}
        for r in rows.select(which.alias("i"), digit.alias("digit"), "size").where("i is not null").groupBy("i", "digit").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            counted[r["i"]][r["digit"]] = (r["size"], r["n"])
        found = {key: counted[i] for i, key in enumerate(ranges)}
        for s in open_:
            s.refine(found[s.range()], tolerance * total / shards, group_share * total / shards)
    return splitters


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes, slots gapless from 0 in the order of the key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text_col), 1).alias("k0"),
        F.shiftrightunsigned(F.xxhash64(id_col), 1).alias("k1"),
        F.monotonically_increasing_id().alias("k2"),
    )
    rows = durable(keyed)
    number = F.lit(0)
    for s in find_splitters(rows, shards, tolerance, group_share):
        number = number + s.before().cast("int")
    ordered = durable(rows.select("*", number.alias("shard")).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)).withColumn("at", F.monotonically_increasing_id())
    placed = ordered.withColumn("part", F.shiftrightunsigned("at", PLACE_BITS))
    met = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = met.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).alias("shift"))
    return placed.join(F.broadcast(shift), ["part", "shard"]).select(id_col, "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
