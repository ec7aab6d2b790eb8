"""Streaming forms of the ledger: heartbeats as sessions, state folded batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state

LATE = "10 minutes"


def sessions(events: DataFrame, gap: str = "180 seconds", late: str = LATE) -> DataFrame:
    """(run_id, started, last_heard, beats) of each stretch of heartbeats without a silence of ``gap``."""
    beats = events.withWatermark("event_time", late).groupBy("run_id", F.session_window("event_time", gap).alias("s"))
    return beats.agg(F.count("*").alias("beats")).select("run_id", F.col("s.start").alias("started"), F.col("s.end").alias("last_heard"), "beats")


def per_minute(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events by severity and minute; late ones count until the watermark has passed."""
    w = events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 minute").alias("w"), "severity")
    return w.agg(F.count("*").alias("events")).select(F.col("w.start").alias("minute"), "severity", "events")


def folding(read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], roots: list[int]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is one scan, folded into the state that ``read`` gives."""

    def one(batch: DataFrame, batch_id: int) -> None:
        now, seen = state.fold(read(), batch, batch_id + 1, roots)
        write(now, seen)

    return one
