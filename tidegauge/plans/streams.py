"""Queries: streams over the events table, run to the end of what it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import market
from ..streaming import claims
from ..streaming import events as streams
from .registry import query


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return streams.file_stream(spark, path, spark.read.parquet(path).schema)


@query("STREAM-01", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_01(spark, sf_dir):
    """Hourly totals from the stream's state."""
    done = streams.run_to_end(streams.window_totals(_stream(spark, sf_dir)), streams.own_folder(spark, "windows"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("STREAM-02", """
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (
        SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_02(spark, sf_dir):
    """Sessions by the same function on the whole table at once."""
    found = streams.sessions(market.table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("STREAM-03", """
    SELECT user_id, event_type, epoch_us(min(ts)) AS claimed_at, arg_min(event_id, (ts, event_id)) AS claimed_by, count(*) AS looks FROM events
    WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL""")
def stream_03(spark, sf_dir):
    """Who holds the claim of each user and type, and how often it was asked for, from the stream's state."""
    keys = ["user_id", "event_type"]
    return claims.holders(claims.claimed(_stream(spark, sf_dir), keys, "ts", "event_id", streams.own_folder(spark, "claims")), keys)
