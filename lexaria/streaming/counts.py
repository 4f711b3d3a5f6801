"""Counts that follow a stream of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def term_counts(stream: DataFrame, time_col: str, tokens: Column, *, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, term, cf): occurrences of each term by window of time, of a stream or a table; rows later than ``lateness`` are dropped by a stream."""
    rows = stream.withWatermark(time_col, lateness) if stream.isStreaming else stream
    return rows.select(F.window(time_col, window).alias("w"), F.explode(tokens).alias("term")).groupBy("w", "term").agg(F.count(F.lit(1)).alias("cf")).select(F.col("w.start").alias("start"), "term", "cf")


def event_sessions(stream: DataFrame, *, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, start, events, total): sessions of a stream or table of events (ts, user_id, value)."""
    rows = stream.withWatermark("ts", lateness) if stream.isStreaming else stream
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")
