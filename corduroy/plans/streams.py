"""Streams replayed from the events table: counters, windows and sessions with late rows, duplicate suppression, row accounting.

The events come in BATCHES batches by time; every 40th comes two batches late, so that most of these are behind the watermark. The SQL
of the late rows says which: a batch's late rows are judged by the watermark that the batch before it ran with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import live as S
from .base import POINTS, query, rows, table

BATCHES, DELAY = 4, "10 minutes"
#: event_id, ts, user_id, event_type, value and the batch in which the event comes.
DELIVERED = f"""SELECT event_id, ts, user_id, event_type, value, least({BATCHES - 1}, own + CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END) AS batch FROM (
  SELECT *, CAST(least({BATCHES - 1}, floor({BATCHES} * (CAST(epoch_us(ts) AS DOUBLE) - min(epoch_us(ts)) OVER ()) / (1 + max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()))) AS BIGINT) AS own FROM events)"""
#: The same with ``mark``, the watermark that judges the event's lateness.
JUDGED = f"""SELECT d.*, m.mark FROM ({DELIVERED}) d LEFT JOIN (
  SELECT a.batch, max(b.ts) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT batch FROM ({DELIVERED})) a JOIN ({DELIVERED}) b ON b.batch < a.batch - 1 GROUP BY a.batch) m ON m.batch = d.batch"""


def _path(spark) -> str:
    return f"{shared_folder(spark)}/corduroy/replay-{uuid.uuid4().hex[:12]}"


def _delivered(spark, d):
    """The events with the batch in which they come, and a row after all of them that moves the watermark on."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    own = F.least(F.lit(BATCHES - 1), F.floor(BATCHES * (F.unix_micros("ts").cast("double") - F.col("lo")) / (1 + F.col("hi") - F.col("lo"))))
    rows = e.join(F.broadcast(span)).withColumn("batch", F.least(F.lit(BATCHES - 1), own + F.when(F.col("event_id") % 40 == 0, 2).otherwise(0)).cast("long"))  # one row
    rows = rows.select("event_id", "ts", "user_id", "event_type", "value", "batch")
    closing = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit(BATCHES).cast("long").alias("batch"))
    return rows, closing


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM ({JUDGED}) WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark GROUP BY 1, 2")
def t_stream_tumbling(spark, d):
    """Hourly counts of the stream in append mode; rows behind the watermark don't count."""
    events, closing = _delivered(spark, d)
    out = S.finished(lambda s: S.windowed_counts(s, "1 hour", late=DELAY), events, closing, "batch", _path(spark), BATCHES)
    return out.where("event_type <> 'close'").select("start", "event_type", "n")


@query(f"""SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM ({JUDGED}) WHERE mark IS NULL OR ts + INTERVAL 30 MINUTE > mark WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def t_stream_sessions(spark, d):
    """Sessions of the stream in append mode."""
    events, closing = _delivered(spark, d)
    out = S.finished(lambda s: S.sessions(s, "30 minutes", DELAY), events, closing, "batch", _path(spark), BATCHES)
    return S.whole_sessions(out.where("user_id >= 0")).select("user_id", "start", "n")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark) AS BIGINT) AS n_counted,
  CAST(count(*) FILTER (WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark) AS BIGINT) AS n_late FROM ({JUDGED})""")
def t_stream_late_rows(spark, d):
    """What came, what was counted and what was behind the watermark."""
    events, closing = _delivered(spark, d)
    out = S.finished(lambda s: S.windowed_counts(s, "1 hour", late=DELAY), events, closing, "batch", _path(spark), BATCHES)
    return S.late_rows(events, out.where("event_type <> 'close'"), "n")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def t_live_counters(spark, d):
    """Counters by state as the last batch leaves them."""
    events, closing = _delivered(spark, d)
    out = S.finished(lambda s: S.counters(s, "event_type"), events, closing, "batch", _path(spark), BATCHES, "complete")
    return out.where("event_type <> 'close'")


REPEATS = f"""SELECT c_custkey AS id, c_mktsegment AS tipo, lat, lon, c_nationkey * 60 AS t FROM ({POINTS})"""


@query(f"""WITH r AS ({REPEATS})
SELECT id, EXISTS (SELECT 1 FROM r o WHERE o.tipo = r.tipo AND o.id < r.id AND abs(o.t - r.t) <= 600 AND 2 * 6371 * asin(sqrt(power(sin((radians(r.lat) - radians(o.lat)) / 2), 2)
  + cos(radians(o.lat)) * cos(radians(r.lat)) * power(sin((radians(r.lon) - radians(o.lon)) / 2), 2))) <= 15) AS repeated FROM r""")
def t_stream_repeated(spark, d):
    """Reports near an earlier one, from a stream with keyed state; the same rows as t_report_duplicates."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = rows(spark, d, POINTS).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tipo"), "lat", "lon", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_nationkey") * 60).alias("ts"), F.floor(F.col("c_nationkey") / 13).alias("batch"))
    closing = r.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("close").alias("tipo"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(2).cast("long").alias("batch"))
    out = S.finished(lambda s: S.repeated_stream(s, 15.0, 600), r, closing, "batch", _path(spark), 2)
    return out.where("id >= 0").select("id", "repeated")
