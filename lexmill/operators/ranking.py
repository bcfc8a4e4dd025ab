"""Row numbers over a whole table without bringing it to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session may leave it unset and gets a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with row numbers from 1 in the given total order.

    Rows are range-partitioned and sorted; each partition numbers its own rows,
    shifted by the counts of those before it (one row for each partition).
    """
    sorted_ = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy(part.alias("__p")).agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn("__p", part).join(F.broadcast(counts), "__p").withColumn(name, low + F.col("__s") + 1).drop("__p", "__s", "__at")


def running(df: DataFrame, *order: Column | str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each in the given total order; distributed as numbered() is."""
    sorted_ = durable(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted_.groupBy("__p").agg(F.sum(value).alias("__c")).select("__p", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = sorted_.withColumn("__b", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return within.join(F.broadcast(sums), "__p").withColumn(name, F.col("__b") + F.col("__s")).drop("__p", "__b", "__s")
