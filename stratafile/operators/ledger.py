"""Runs, stages and events: status ladders, close-out counts, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

#: Outcomes of roots, best first; what isn't listed is worse than all (fixed values).
ROOT_ORDER = ("completed", "completed_with_warnings", "skipped", "failed")
#: Seconds after which a heartbeat no longer proves that a run is alive (fixed value).
STALE_SECONDS = 180
#: Stages that don't fail a run (fixed values).
NON_FATAL_STAGES = ("inventory_ingest",)


def severity(event_type: Column) -> Column:
    return F.when(event_type == "error", "error").when(event_type == "signup", "warning").otherwise("info")


def stage_status(exit_code: Column, has_output: Column, warnings: Column) -> Column:
    """2 is a pause, other codes a failure; no output means nothing applied; events make warnings."""
    return F.when(exit_code == 2, "paused").when(exit_code != 0, "failed").when(~has_output, "no_applicable_files").when(warnings > 0, "completed_with_warnings").otherwise("completed")


def worst(status: Column, order: tuple[str, ...] = ROOT_ORDER) -> Column:
    """Aggregate: the worst status that occurs in a group, null if none does."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(order) for x in (k, i)])[status], F.lit(len(order)))
    return F.max(F.when(status.isNotNull(), F.struct(rank.alias("rank"), status.alias("status"))))["status"]


def run_status(status: Column, stage: Column, non_fatal: tuple[str, ...] = NON_FATAL_STAGES, tolerant: bool = False) -> Column:
    """Aggregate: the status of a run from those of its stages.

    A stage that was interrupted or paused says so for the run. A failure of a
    non-fatal stage, or any failure of a ``tolerant`` run, is a warning; the
    stage's own row keeps it. A run without stages is completed.
    """
    has = lambda what: F.coalesce(F.bool_or(what), F.lit(False))
    failed = status == "failed"
    fatal = F.lit(False) if tolerant else has(failed & ~stage.isin(*non_fatal))
    warned = has(failed | (status == "completed_with_warnings"))
    return F.when(has(status == "interrupted"), "interrupted").when(has(status == "paused"), "paused").when(fatal, "failed").when(warned, "completed_with_warnings").otherwise("completed")


def closed(events: DataFrame, *by: str) -> DataFrame:
    count = lambda k: F.count_if(F.col("severity") == k).alias(f"{k}s")
    return events.groupBy(*by).agg(F.count("*").alias("events"), count("error"), count("warning"), count("info"))


def numbered(events: DataFrame, last: DataFrame) -> DataFrame:
    """Adds ``seq``, going on without gaps from each run's last number; a run of any size is numbered over several tasks."""
    rows = ranked(events, "__place", ["run_id"], [F.col("event_time"), F.col("event_id")])
    return rows.join(last, "run_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.col("__place")).drop("last_seq", "__place")


def stale_runs(runs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Open runs whose process is known dead, silent for too long or never heard; an unknown process counts as alive while it is heard.

    Before its first heartbeat a run was heard when it ``started``, if ``runs`` has that.
    """
    heard = F.coalesce("heartbeat", "started") if "started" in runs.columns else F.col("heartbeat")
    age = F.unix_micros(now) - F.unix_micros(heard)
    why = F.when(F.col("alive") == F.lit(False), "process_gone").when(age.isNull() | (age > seconds * 1_000_000), "heartbeat_expired")
    return runs.where("ended is null").withColumn("reason", why).where("reason is not null")


def coverage(marks: DataFrame) -> DataFrame:
    """One row for each run and root: scanned if any mark says so, other facts the last known."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
    return marks.groupBy("run_id", "root_id").agg(F.bool_or("was_scanned").alias("was_scanned"), known("files_seen"), known("note"))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, with how many there were and whether some are left out."""
    placed = ranked(rows, "place", by, order, size="seen")
    return placed.where(F.col("place") <= cap).withColumn("truncated", F.col("seen") > cap)
