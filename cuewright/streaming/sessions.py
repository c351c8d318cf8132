"""Streaming pause sessions: the pause rule over an unbounded stream of events.

Spark's session windows join sessions that touch, so a gap one microsecond short of the pause
gives the rule of the batch operator: a pause of exactly the gap starts a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pause_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_s: int = 21_600, late: str = "1 day") -> DataFrame:
    """(key, start_s, end_s, n_events) of sessions; works on streams and on tables."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key), at.alias("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.session_window("ts", f"{gap_s * 1_000_000 - 1} microseconds")
    out = rows.groupBy(key, window.alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n_events"))
    return out.select(key, F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"), "n_events")
