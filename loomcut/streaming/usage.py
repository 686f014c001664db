"""Event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcut.operators.code import chunk_files_stream

__all__ = ["chunk_files_stream", "first_messages", "usage_by_window"]


def first_messages(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (session, message_id) once; its state is kept for as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "message_id"])


def usage_by_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tokens of distinct messages by session and window of event time."""
    once = first_messages(events, late)
    per = once.groupBy(F.window("ts", window), "session").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("messages"))
    return per.select(F.col("window.start").alias("start"), "session", "input_tokens", "output_tokens", "messages")
