"""Windows over event streams; the same functions serve streams and tables.

These are extensions: the query layer has no stream of its own.  A stream gets its watermark here; on a table the
watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import table


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    g = _timed(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    g = _timed(events, delay).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    g = _timed(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


def once(events: DataFrame, key: str = "event_id", delay: str = "2 days") -> DataFrame:
    """Each event once, however often it is delivered within the delay (idempotent append)."""
    e = _timed(events, delay)
    return e.dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def append_available(events: DataFrame, path: str, checkpoint: str, partition_by: list[str]):
    """Append what is new since the last run to a partitioned table, then stop."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()


def stream_tumbling(spark, d):
    return tumbling(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def stream_sliding(spark, d):
    return sliding(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def stream_sessions(spark, d):
    return sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "n")


def stream_once(spark, d):
    e = table(spark, d, "events")
    return once(e.unionByName(e.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_once)}
SQL = {
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(date_trunc('day', ts) - to_days(i::INT), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, range(0, 2) t(i) GROUP BY 1, 2",
    "stream_sessions": "WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
