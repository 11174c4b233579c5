"""Incremental ingest with Structured Streaming: late rows and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_notices(stream: DataFrame, time: str, key: list[str], lateness: str = "45 days") -> DataFrame:
    """The first sight of each key; state is kept for as long as portals back-date notices."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)
