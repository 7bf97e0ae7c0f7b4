"""Windowed aggregation over event time; the same functions serve batches and Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, keys: Sequence[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    return _grouped(events, F.window(time, size), time, keys, aggregates, late)


def sliding(events: DataFrame, time: str, size: str, step: str, keys: Sequence[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    return _grouped(events, F.window(time, size, step), time, keys, aggregates, late)


def session(events: DataFrame, time: str, gap: str, keys: Sequence[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    return _grouped(events, F.session_window(time, gap), time, keys, aggregates, late)


def _grouped(events: DataFrame, window: Column, time: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None) -> DataFrame:
    """``late``: how long a window waits for late rows before its state goes."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])
