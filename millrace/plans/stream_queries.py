"""Queries over the stream of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation
from millrace.sources.tables import table
from millrace.streaming import admission, windows


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark, sf_dir):
    found = windows.windowed(_events(spark, sf_dir))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


EVENT_WINDOWS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def event_windows_stream(spark, sf_dir):
    """The same windows by a stream over the files of the table."""
    found = windows.run_to_table(windows.windowed(_stream(spark, sf_dir)), spark)
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def event_admission(spark, sf_dir):
    """Two events per user and day."""
    rows = admission.admitted(_events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), "ts"), 2, 86_400)
    return rows.select("event_id", F.col("key").alias("user_id"), "allowed")


def event_admission_stream(spark, sf_dir):
    events = _stream(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), "ts")
    rows = windows.run_to_table(admission.admitted_stream(events, 2, 86_400), spark, "append")
    return rows.select("event_id", F.col("key").alias("user_id"), "allowed")


ADMISSION = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT event_id, user_id, i, [ts] AS times, true AS allowed FROM o WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, CASE WHEN len(kept) < 2 THEN kept || [ts] ELSE kept END, len(kept) < 2
  FROM (SELECT o.*, list_filter(a.times, lambda t: t >= o.ts - INTERVAL 1 DAY) AS kept FROM a JOIN o ON o.user_id = a.user_id AND o.i = a.i + 1))
SELECT event_id, user_id, allowed FROM a"""


def recent_events(spark, sf_dir):
    """For each event, how many events the user had in the day up to it, itself included."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.trailing_counts(rows, "user_id", "event_id", 86_400)


RECENT = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events"


def event_histogram(spark, sf_dir):
    return evaluation.histogram(_events(spark, sf_dir), ["event_type"], F.col("value"), evaluation.SECONDS)


HISTOGRAM = f"""WITH b AS (SELECT unnest([{', '.join(map(str, evaluation.SECONDS))}, 'inf'::DOUBLE]) AS le)
SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b GROUP BY event_type, le"""


def last_values(spark, sf_dir):
    """The last value of each user and event type, and the running key of its properties."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    last = F.struct("ts", "event_id")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("value", last).alias("value"), F.max_by(F.get_json_object("props", "$.k").try_cast("bigint"), last).alias("k"))


LAST_VALUES = "SELECT user_id, event_type, arg_max_null(value, (ts, event_id)) AS value, arg_max_null(TRY_CAST(props ->> '$.k' AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY user_id, event_type"

QUERIES = {
    "event_windows": event_windows,
    "event_windows_stream": event_windows_stream,
    "event_admission": event_admission,
    "event_admission_stream": event_admission_stream,
    "recent_events": recent_events,
    "event_histogram": event_histogram,
    "last_values": last_values,
}
ORACLES = {"event_admission": ADMISSION, "event_admission_stream": ADMISSION, "event_windows": EVENT_WINDOWS, "event_windows_stream": EVENT_WINDOWS, "recent_events": RECENT, "event_histogram": HISTOGRAM, "last_values": LAST_VALUES}
