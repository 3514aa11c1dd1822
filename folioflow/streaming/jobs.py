"""Structured Streaming jobs: first events, sessions, daily failures and the latest state of a board."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_events(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Events without repeats of their key; a repeat later than ``late`` is not recognised, which bounds the state."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, reader: str, at: str, gap: str, late: str) -> DataFrame:
    """Reading sessions: inputs less than ``gap`` apart belong together. Works on streams and on tables."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    found = rows.groupBy(reader, F.session_window(at, gap).alias("session")).agg(F.count("*").alias("inputs"))
    return found.select(reader, F.col("session.start").alias("started_at"), F.col("session.end").alias("ended_at"), "inputs")


def daily_failures(events: DataFrame, at: str, code: str, late: str) -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 day").alias("day"), code).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), code, "n")


def merge_latest(events: DataFrame, keys: list[str], order: list[str], read: Callable[[int], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Fold a stream into the latest row per key.

    Each batch is united with the stored rows and written under its batch number, so a
    repeated batch writes the same rows again. ``read(number)`` gives the rows that batches
    before that number have left, or None at first.
    """
    columns = events.columns

    def fold(batch: DataFrame, number: int) -> None:
        stored = read(number)
        rows = batch if stored is None else batch.unionByName(stored.select(columns))
        rest = [c for c in columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(columns)
        write(latest, number)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
