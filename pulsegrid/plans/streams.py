"""Structured Streaming over `events`: appended results are those that the watermark has
closed, so the SQL leaves out what ends within an hour of the last event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.registry import query
from pulsegrid.streaming import beats, runs, windows

LAST = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d') AS day, event_type, n, total FROM w WHERE s + INTERVAL 1 DAY <= {LAST}""")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.settled(windows.tumbling(runs.read(spark, sf_dir, "events"), "1 day", "event_type"), "tumbling")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
f AS (SELECT user_id, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, epoch_us(a) // 1000 AS first_ms, n FROM f WHERE b + INTERVAL 6 HOUR <= {LAST}""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.settled(windows.sessions(runs.read(spark, sf_dir, "events"), "6 hours", "user_id"), "sessions")
    return found.select("user_id", F.unix_millis("start").alias("first_ms"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice count once."""
    stream = runs.read(spark, sf_dir, "events")
    return runs.settled(windows.once(stream.unionByName(runs.read(spark, sf_dir, "events")), "event_id"), "once").select("event_id", "user_id", "event_type")


@query()
def beats_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats found in each user's events, taken as samples."""
    from pulsegrid.plans.signal import recordings

    samples = recordings(spark, sf_dir).select(F.col("user_id").alias("record"), "t", "value")
    return beats.detect(samples, fs=8)


@query()
def beats_batch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's variant that goes by means, over the same samples."""
    from pulsegrid.plans.signal import recordings

    samples = recordings(spark, sf_dir).select(F.col("user_id").alias("record"), "t", "value")
    return beats.detect(samples, fs=8, how=beats.BY_MEAN)
