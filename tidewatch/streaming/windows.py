"""Windowed counts that run the same on a batch and on a stream.

On a stream the watermark
bounds the state, and late rows beyond it are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(events: DataFrame, window: Column, late: str | None) -> DataFrame:
    rows = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = rows.withWatermark("timestamp", late) if late else rows
    got = rows.groupBy(window.alias("w"), "entity_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return got.select("entity_id", show("w.start").alias("start"), show("w.end").alias("end"), "n", F.round("total", 3).alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    return _counts(events, F.window("timestamp", width), late)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    return _counts(events, F.window("timestamp", width, step), late)


def session(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of an entity's events with less than ``gap`` between neighbours; the
    end is the last event plus the gap."""
    return _counts(events, F.session_window("timestamp", gap), late)


def call_then_transfer(calls: DataFrame, transfers: DataFrame, tolerance: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(call_id, event_id, counterparty_id, at): transfers within ``tolerance``
    after a call with the same counterparty. On streams the watermarks and the
    time bound let both sides' state expire."""
    left = calls.select(F.col("event_id").alias("call_id"), F.col("counterparty_id").alias("called"), F.col("timestamp").cast("timestamp").alias("called_at"))
    right = transfers.select("event_id", "counterparty_id", F.col("timestamp").cast("timestamp").alias("at"))
    if calls.isStreaming:
        left, right = left.withWatermark("called_at", late), right.withWatermark("at", late)
    bound = f"called = counterparty_id AND at >= called_at AND at <= called_at + INTERVAL {tolerance}"
    return left.join(right, F.expr(bound)).select("call_id", "event_id", "counterparty_id", "at")
