"""Streaming queries over the tables: read as a stream, written to the shared folder, with the same results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.functions import expressions as X
from lexmill.operators.ranking import shared_folder
from lexmill.plans.catalog import _QUALITY, case_sql, query
from lexmill.sources import readers
from lexmill.streaming import timers


@query(
    f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS "at", {case_sql(_QUALITY, 'event_type')} AS q FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", id) AS k, now FROM e, (SELECT max("at") - {timers.DAY} AS now FROM e WHERE q IS NOT NULL) WHERE q IS NOT NULL AND "at" <= now
), s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(2.5 AS DOUBLE) AS ease, 0 AS "interval", 0 AS reps, CAST(0 AS BIGINT) AS "at", CAST(0 AS BIGINT) AS id FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT s.user_id, r.k, CAST(greatest(1.3, round(s.ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 2)) AS DOUBLE),
    CASE WHEN q < 3 THEN 1 WHEN s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE greatest(1, CAST(round_even(least(s."interval" * s.ease, 2147483647), 0) AS INTEGER)) END,
    CASE WHEN q < 3 THEN 0 ELSE s.reps + 1 END, r."at", r.id
  FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1
), n AS (
  SELECT *, "at" + "interval" * CAST({timers.DAY} AS BIGINT) AS due, coalesce(lead("at") OVER (PARTITION BY user_id ORDER BY k), (SELECT max(now) FROM r)) AS until FROM s WHERE k > 0
)
SELECT CAST(user_id AS VARCHAR) AS key, 'reviewed' AS kind, "at", id, ease, "interval", reps FROM n
UNION ALL SELECT CAST(user_id AS VARCHAR), 'due', due, -1, ease, "interval", reps FROM n WHERE due <= until"""
)
def review_news(spark, d):
    """Every review of the events in order, and every word (user) that fell due, from a stream that reads the table once."""
    timers.needs_timers(spark)
    base = f"{shared_folder(spark).rstrip('/')}/news-{uuid.uuid4().hex}"
    events = readers.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")  # a pattern may be a file or a folder
    rows = stream.select("user_id", "ts", F.col("event_id").alias("id"), X.mapping(_QUALITY, F.col("event_type")).alias("quality"))
    news = timers.review_news(rows, "user_id")
    query_ = news.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/news").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(timers.NEWS).parquet(f"{base}/news").withColumn("id", F.coalesce("id", F.lit(-1)))
