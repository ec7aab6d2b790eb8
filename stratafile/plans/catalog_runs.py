"""Queries on runs, stages and events. Each user of ``events`` stands for a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import corpus, logs
from .registry import query

EVENTS = "(SELECT event_id, user_id AS run_id, ts, event_type, value, props, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity FROM events)"


def events(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("event_time"), "event_type", "value", "props", ledger.severity(F.col("event_type")).alias("severity"))


CLOSED = "count(*) AS events, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos"


@query("a25_event_counts", f"SELECT run_id, event_type AS stage_key, {CLOSED} FROM {EVENTS} GROUP BY ALL")
def a25(spark, sf_dir):
    return ledger.closed(events(spark, sf_dir).withColumnRenamed("event_type", "stage_key"), "run_id", "stage_key")


@query("a25_run_close_out", f"SELECT run_id, {CLOSED} FROM {EVENTS} GROUP BY run_id")
def a25_run(spark, sf_dir):
    return ledger.closed(events(spark, sf_dir), "run_id")


@query("k18_event_sequence", f"SELECT event_id, run_id, (run_id % 3) * 10 + row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM {EVENTS}")
def k18(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.select("run_id").distinct().where("run_id % 3 <> 0").withColumn("last_seq", F.col("run_id") % 3 * 10)
    return ledger.numbered(e.select("event_id", "run_id", "event_time"), last).select("event_id", "run_id", "seq")


STAGES = "(SELECT user_id AS run_id, event_type AS stage_key, CASE WHEN count(*) % 7 = 0 THEN 2 WHEN count(*) % 5 = 0 THEN 1 ELSE 0 END AS exit_code, sum(value) IS NOT NULL AND count(*) % 3 <> 0 AS has_output, count(*) FILTER (event_type IN ('error', 'signup')) AS warnings FROM events GROUP BY ALL)"
STATUS = "CASE WHEN exit_code = 2 THEN 'paused' WHEN exit_code <> 0 THEN 'failed' WHEN NOT has_output THEN 'no_applicable_files' WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END"


def stages(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("run_id", F.col("event_type").alias("stage_key"))
    n = F.count("*")
    rows = e.agg(
        F.when(n % 7 == 0, 2).when(n % 5 == 0, 1).otherwise(0).alias("exit_code"), (F.sum("value").isNotNull() & (n % 3 != 0)).alias("has_output"),
        F.count_if(F.col("severity").isin("error", "warning")).alias("warnings"),
    )
    return rows.withColumn("status", ledger.stage_status(F.col("exit_code"), F.col("has_output"), F.col("warnings")))


@query("l2_stage_status", f"SELECT run_id, stage_key, exit_code, {STATUS} AS status FROM {STAGES}")
def l2(spark, sf_dir):
    return stages(spark, sf_dir).select("run_id", "stage_key", "exit_code", "status")


RUN_STATUS = "CASE WHEN bool_or(status = 'interrupted') THEN 'interrupted' WHEN bool_or(status = 'paused') THEN 'paused' WHEN bool_or(status = 'failed' AND stage_key <> 'view') THEN 'failed' WHEN bool_or(status IN ('failed', 'completed_with_warnings')) THEN 'completed_with_warnings' ELSE 'completed' END"


@query("a28_run_status", f"SELECT run_id, {RUN_STATUS} AS status, count(*) AS stages FROM (SELECT run_id, stage_key, {STATUS} AS status FROM {STAGES}) GROUP BY run_id")
def a28(spark, sf_dir):
    """Stages are event types; ``view`` is a stage that doesn't fail its run."""
    return stages(spark, sf_dir).groupBy("run_id").agg(run_status().alias("status"), F.count("*").alias("stages"))


def run_status():
    return ledger.run_status(F.col("status"), F.col("stage_key"), ("view",))


@query(
    "a29_multi_root_status",
    f"""SELECT run_id, arg_max(status, CASE status WHEN 'completed' THEN 0 WHEN 'completed_with_warnings' THEN 1 WHEN 'skipped' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END) AS status FROM (
      SELECT run_id, CASE WHEN status = 'no_applicable_files' THEN 'skipped' WHEN status <> 'paused' THEN status END AS status FROM (SELECT run_id, {STATUS} AS status FROM {STAGES})) GROUP BY run_id""",
)
def a29(spark, sf_dir):
    """Each stage of a run stands for one of its roots; a paused one has no outcome yet."""
    s = F.col("status")
    rows = stages(spark, sf_dir).withColumn("status", F.when(s == "no_applicable_files", "skipped").when(s != "paused", s))
    return rows.groupBy("run_id").agg(ledger.worst(s).alias("status"))


@query(
    "i5s_stale_runs",
    f"""SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'process_gone' ELSE 'heartbeat_expired' END AS reason FROM (
      SELECT run_id, CASE WHEN run_id % 11 <> 0 THEN max(ts) END AS beat FROM {EVENTS} GROUP BY run_id) WHERE run_id % 7 <> 0 AND (run_id % 5 = 0 OR beat IS NULL OR epoch((SELECT max(ts) FROM events)) - epoch(beat) > 180)""",
)
def i5s(spark, sf_dir):
    """Heartbeats are events; every fifth run's process is known dead, of every second other one nothing is known, every eleventh was never heard.

    Every seventh has ended, also if no time is known. Events of no run count for the time of now alone.
    """
    e = events(spark, sf_dir)
    k = F.col("run_id")
    runs = e.where(k.isNotNull()).groupBy("run_id").agg(F.max("event_time").alias("heartbeat"))
    ended = F.when(k % 7 == 0, F.coalesce("heartbeat", F.timestamp_seconds(F.lit(0))))
    runs = runs.select("run_id", F.when(k % 11 != 0, F.col("heartbeat")).alias("heartbeat"), F.when(k % 5 == 0, False).when(k % 2 == 0, True).alias("alive"), ended.alias("ended"))
    now = e.agg(F.max("event_time").alias("now")).withColumn("one", F.lit(1))
    return ledger.stale_runs(runs.withColumn("one", F.lit(1)).join(F.broadcast(now), "one"), F.col("now")).select("run_id", "reason")


@query("k13_root_coverage", "SELECT user_id AS run_id, event_id % 4 AS root_id, bool_or(event_type = 'purchase') AS was_scanned, arg_max(value, event_id) FILTER (value IS NOT NULL AND event_id % 2 = 0) AS files_seen, arg_max(event_type, event_id) AS note FROM events GROUP BY ALL")
def k13(spark, sf_dir):
    marks = events(spark, sf_dir).select(
        "run_id", (F.col("event_id") % 4).alias("root_id"), (F.col("event_type") == "purchase").alias("was_scanned"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("files_seen"), F.col("event_type").alias("note"), F.col("event_id").alias("turn"),
    )
    return ledger.coverage(marks)


@query("k14_environment_snapshots", "SELECT sha256(event_type || '|' || (user_id % 5)) AS environment_hash, min(event_id) AS first_event, count(*) AS uses FROM events GROUP BY 1")
def k14(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(F.sha2(F.concat_ws("|", "event_type", (F.col("run_id") % 5).cast("string")), 256).alias("environment_hash")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("uses"))


@query("t6_latest_runs", f"SELECT run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event FROM {EVENTS} GROUP BY run_id ORDER BY max(ts) DESC, run_id DESC LIMIT 10")
def t6(spark, sf_dir):
    runs = events(spark, sf_dir).groupBy("run_id").agg(F.max("event_time").alias("t")).orderBy(F.desc("t"), F.desc("run_id")).limit(10)
    return runs.select("run_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_event"))


@query("s8_event_json", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN event_id % 10 <> 0 THEN event_type END AS category FROM events")
def s8(spark, sf_dir):
    """Every tenth event as a broken line: it is kept as a warning."""
    e = events(spark, sf_dir)
    good = F.to_json(F.struct(F.lit("info").alias("severity"), F.col("event_type").alias("category"), F.col("props").alias("detail")))
    lines = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring(good, 1, 9)).otherwise(good).alias("line"))
    rows = lines.select("event_id", F.from_json("line", logs.EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("event_id", "e.*")
    return logs.mark_bad(rows).select("event_id", "severity", "category")


@query(
    "s9_error_lines",
    r"""SELECT run_id, line_no, severity, error_type, file_path, message, file_skipped FROM (
      SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS line_no, 'warning' AS severity,
        CASE WHEN event_type = 'error' THEN 'FILE ERROR' WHEN event_type = 'signup' THEN 'DIRECTORY ACCESS ERROR' END AS error_type,
        CASE WHEN event_type IN ('error', 'signup') THEN 'C:\x\' || event_id END AS file_path,
        CASE event_type WHEN 'error' THEN 'denied -- twice' WHEN 'signup' THEN 'no list' WHEN 'click' THEN 'OTHER ERROR: a -- b' ELSE 'all is well' END AS message,
        CASE WHEN event_type IN ('error', 'signup') THEN true END AS file_skipped FROM ERRORS) WHERE line_no <= 4
    UNION ALL SELECT run_id, 5, 'info', NULL, NULL, 'Only the first 4 entries were recorded as events; the full list remains in the file.', NULL FROM ERRORS GROUP BY run_id HAVING count(*) >= 4""".replace("ERRORS", EVENTS).replace("\\\\", "\\"),
)
def s9(spark, sf_dir):
    """Each run's events as the lines of its error file."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(F.lit("FILE ERROR: C:\\x\\"), "event_id", F.lit(" -- denied -- twice"))).when(kind == "signup", F.concat(F.lit(" DIRECTORY ACCESS ERROR:  C:\\x\\"), "event_id", F.lit("  -- no list")))
        .when(kind == "click", "OTHER ERROR: a -- b").otherwise("all is well")
    )
    found = logs.error_events(e.select("run_id", "event_id", line.alias("line")), ["run_id"], [F.col("event_id")], 4)
    return found.select("run_id", "line_no", "severity", "error_type", "file_path", "message", "file_skipped")


@query(
    "s10_console_capture",
    f"""SELECT run_id, event_id, severity, seen, seen > 3 AS truncated FROM (SELECT run_id, event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS severity, count(*) OVER (PARTITION BY run_id) AS seen,
      row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS place FROM {EVENTS} WHERE event_type IN ('error', 'signup')) WHERE place <= 3""",
)
def s10(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.when(F.col("event_type") == "error", "  Error: disk").when(F.col("event_type") == "signup", "warn slow").otherwise("ERRORS are fine")
    rows = e.select("run_id", "event_id", logs.console_severity(line).alias("severity")).where("severity is not null")
    return ledger.capped(rows, ["run_id"], [F.col("event_id")], 3).select("run_id", "event_id", "severity", "seen", "truncated")


@query("x3_scan_rows", "SELECT user_id AS run_id, event_id % 4 AS root_id, min(event_id) AS first_event FROM events GROUP BY ALL")
def x3(spark, sf_dir):
    return events(spark, sf_dir).groupBy("run_id", (F.col("event_id") % 4).alias("root_id")).agg(F.min("event_id").alias("first_event"))


@query("x5_newest_completed_run", f"SELECT root_id, max(run_id) AS run_id FROM (SELECT run_id, run_id % 4 AS root_id, {RUN_STATUS} AS status FROM (SELECT run_id, stage_key, {STATUS} AS status FROM {STAGES}) GROUP BY run_id) WHERE status IN ('completed', 'completed_with_warnings') GROUP BY root_id")
def x5(spark, sf_dir):
    runs = stages(spark, sf_dir).groupBy("run_id").agg(run_status().alias("status"))
    done = runs.where(F.col("status").isin("completed", "completed_with_warnings"))
    return done.groupBy((F.col("run_id") % 4).alias("root_id")).agg(F.max("run_id").alias("run_id"))


@query("x24_run_events", f"SELECT event_id, event_type, severity FROM {EVENTS} WHERE run_id = 7")
def x24(spark, sf_dir):
    return events(spark, sf_dir).where("run_id = 7").select("event_id", "event_type", "severity")


@query("x25_runs_across_projects", f"SELECT project, count(*) AS runs, count(*) FILTER (n > 5) AS busy FROM (SELECT run_id % 2 AS project, run_id, count(*) AS n FROM {EVENTS} GROUP BY ALL) GROUP BY project")
def x25(spark, sf_dir):
    e = events(spark, sf_dir)
    parts = [e.where(F.col("run_id") % 2 == p).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("project", F.lit(p).cast("long")) for p in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("project").agg(F.count("*").alias("runs"), F.count_if(F.col("n") > 5).alias("busy"))


@query("j15_coverage_roots", "SELECT r.root_id, count(e.event_id) AS events FROM roots r LEFT JOIN events e ON e.event_id % 4 + 1 = r.root_id AND e.event_type = 'error' GROUP BY r.root_id")
def j15(spark, sf_dir):
    e = events(spark, sf_dir).where("severity = 'error'").select((F.col("event_id") % 4 + 1).cast("int").alias("root_id"), "event_id")
    return corpus.roots(spark).select("root_id").join(e, "root_id", "left").groupBy("root_id").agg(F.count("event_id").alias("events"))
