"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_union_stream(words: DataFrame, key: str, time: str, sets: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and key the earliest time, the sets of the given columns and the count, late rows within `late` included."""
    return (
        words.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.min(time).alias("first_at"), *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "first_at", *sets, "n")
    )


def deduplicated_stream(rows: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Rows delivered twice come out once, as long as they arrive within `late` of each other."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def session_stream(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Islands of events of a key that are at most `gap` apart."""
    return (
        events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")
    )
