"""Runs and stages as a log of transitions: what began, what ended and how.

``changes`` are rows (run_id, sequence, stage_key, action, at, status, note)
that are only ever appended; the current rows are a fold of them. Sequence 0
is the run itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = "run_id long, sequence int, stage_key string, action string, at timestamp, status string, note string"


def change(action: str, run: Column, at: Column, sequence: Column | None = None, stage: Column | None = None, status: Column | None = None, note: Column | None = None) -> list[Column]:
    """The columns of one transition: ``create``, ``finish`` or ``skip``."""
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c.cast("string")
    return [
        run.cast("long").alias("run_id"), (F.lit(0) if sequence is None else sequence).cast("int").alias("sequence"), pick(stage).alias("stage_key"), F.lit(action).alias("action"),
        at.cast("timestamp").alias("at"), pick(status).alias("status"), pick(note).alias("note"),
    ]


def current(changes: DataFrame) -> DataFrame:
    """One row for each run and stage: started, ended, duration_ms, status and the last note.

    What was only created is running; what was skipped never ran; of several
    ends the last one holds, and one that comes before its start counts for nothing.
    """
    begun = F.min(F.when(F.col("action") == "create", F.col("at")))
    end = F.max(F.when(F.col("action").isin("finish", "skip"), F.struct("at", "action", "status", "note")))
    rows = changes.groupBy("run_id", "sequence").agg(F.max("stage_key").alias("stage_key"), begun.alias("started_utc"), end.alias("end"))
    late = F.col("end").isNotNull() & (F.col("started_utc").isNull() | (F.col("end.at") >= F.col("started_utc")))
    skipped = late & (F.col("end.action") == "skip")
    ended = F.when(late, F.col("end.at"))
    status = F.when(skipped, "skipped").when(late, F.coalesce("end.status", F.lit("completed"))).otherwise("running")
    took = F.when(~skipped, (F.unix_micros(ended) - F.unix_micros("started_utc")) / 1000).cast("long")
    return rows.select("run_id", "sequence", "stage_key", "started_utc", ended.alias("ended_utc"), took.alias("duration_ms"), status.alias("status"), F.when(late, F.col("end.note")).alias("note"))


def runs(changes: DataFrame) -> DataFrame:
    """The runs with how many stages each has and how many of them failed."""
    rows = current(changes)
    stages = rows.where("sequence > 0").groupBy("run_id").agg(F.count("*").alias("stage_count"), F.count_if(F.col("status") == "failed").alias("failed_stages"))
    whole = rows.where("sequence = 0").select("run_id", "started_utc", "ended_utc", "duration_ms", "status", "note")
    return whole.join(stages, "run_id", "left").fillna(0, ["stage_count", "failed_stages"])


def interrupted(changes: DataFrame, stale: DataFrame, at: Column) -> DataFrame:
    """Transitions that close stale runs (run_id, reason) and whatever of their stages is still open."""
    rows = current(changes).where("status = 'running'").join(stale.select("run_id", "reason"), "run_id")
    return rows.select(*change("finish", F.col("run_id"), at, F.col("sequence"), F.col("stage_key"), F.lit("interrupted"), F.concat(F.lit("Reconciled: "), "reason")))
