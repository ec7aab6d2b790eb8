"""Queries on reports, clocks and the life cycle of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, times
from ..operators import hashing, lifecycle, reports
from ..sources import corpus
from .catalog_content import entries
from .catalog_inventory import inventory
from .catalog_runs import EVENTS, STAGES, STATUS, events, stages
from .registry import query


def report_rows(spark, sf_dir, window=64):
    """A run's results with what the reports show beside them."""
    r = hashing.selective(entries(spark, sf_dir), window)
    f = inventory(spark, sf_dir, (1,)).select("file_id", "relative_path", "extension", "attributes", "depth", "path_length", F.col("is_offline_or_cloud").alias("cloud"), F.struct(paths.walk_key(F.col("relative_path")), F.col("file_id")).alias("place"))
    return r.join(f, "file_id")


@query(
    "r2_size_group_totals",
    "SELECT count(*) AS files, count(size_group_id) AS kept, count(DISTINCT size_group_id) AS groups, (SELECT sum(reclaim) FROM cand_sizes)::BIGINT AS reclaim FROM selective",
    window=64,
)
def r2_totals(spark, sf_dir):
    r = report_rows(spark, sf_dir)
    each = r.groupBy("size_group_id").agg(F.count("*").alias("n"), (F.max("size_bytes") * (F.count("*") - 1)).alias("x"))
    mine = F.col("size_group_id").isNotNull()
    return each.agg(F.sum("n").alias("files"), F.sum(F.when(mine, F.col("n"))).alias("kept"), F.count("size_group_id").alias("groups"), F.sum(F.when(mine, F.col("x"))).alias("reclaim"))


@query(
    "r4_report_resolution_w64",
    "SELECT final_status, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM selective GROUP BY final_status",
    window=64,
)
def r4_resolution(spark, sf_dir):
    return report_rows(spark, sf_dir).groupBy("final_status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(
    "l1_run_and_stage_rows",
    f"""SELECT run_id, sequence::INT AS sequence, stage_key, CASE WHEN n % 11 = 0 THEN 'skipped' WHEN n % 13 = 0 THEN 'running' ELSE status END AS status,
      CASE WHEN n % 11 <> 0 AND n % 13 <> 0 THEN n * 1000 END AS duration_ms FROM (
      SELECT run_id, stage_key, {STATUS} AS status, n, row_number() OVER (PARTITION BY run_id ORDER BY stage_key) AS sequence FROM (SELECT s.*, e.n FROM {STAGES} s JOIN (SELECT user_id AS run_id, event_type AS stage_key, count(*) AS n FROM events GROUP BY ALL) e USING (run_id, stage_key)))""",
)
def l1(spark, sf_dir):
    """Each stage begins and ends a second later for each of its events; some are skipped, some never end, some are ended twice."""
    n = events(spark, sf_dir).groupBy("run_id", F.col("event_type").alias("stage_key")).agg(F.count("*").alias("n"))
    s = stages(spark, sf_dir).join(n, ["run_id", "stage_key"])
    s = s.join(s.groupBy("run_id").agg(F.array_sort(F.collect_set("stage_key")).alias("all")), "run_id").withColumn("sequence", F.array_position("all", F.col("stage_key")).cast("int"))
    at = F.timestamp_seconds(F.lit(1704067200))
    later = F.timestamp_seconds(F.lit(1704067200) + F.col("n"))
    place = (F.col("run_id"), at, F.col("sequence"), F.col("stage_key"))
    begun = s.where("n % 11 <> 0").select(*lifecycle.change("create", *place))
    skipped = s.where("n % 11 = 0").select(*lifecycle.change("skip", *place))
    ended = s.where("n % 11 <> 0 and n % 13 <> 0").select(*lifecycle.change("finish", F.col("run_id"), later, F.col("sequence"), F.col("stage_key"), F.col("status")))
    early = s.where("n % 2 = 0 and n % 11 <> 0 and n % 13 <> 0").select(*lifecycle.change("finish", F.col("run_id"), at, F.col("sequence"), F.col("stage_key"), F.lit("failed")))
    rows = lifecycle.current(begun.unionByName(skipped).unionByName(ended).unionByName(early))
    return rows.select("run_id", "sequence", "stage_key", "status", "duration_ms")


@query(
    "r7_run_report",
    f"SELECT part, seq, count(*) AS entries FROM (SELECT 'stage' AS part, row_number() OVER (ORDER BY stage_key) AS seq FROM {STAGES} WHERE run_id = 7 UNION ALL SELECT 'event', event_id FROM {EVENTS} WHERE run_id = 7 UNION ALL SELECT 'run', 7) GROUP BY ALL",
)
def r7(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("seq", F.col("event_id"))
    s = stages(spark, sf_dir).where("run_id = 7")
    s = s.withColumn("sequence", F.row_number().over(Window.partitionBy("run_id").orderBy("stage_key")))
    runs = e.select("run_id").distinct()
    return reports.run_report(runs, s, e, 7).groupBy("part", "seq").agg(F.count("*").alias("entries"))


@query(
    "f10_local_clocks",
    """SELECT event_id, strftime(t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y-%m-%dT%H:%M:%S') AS local, date_diff('minute', t, t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::INT AS offset_minutes
    FROM (SELECT event_id, date_trunc('second', ts::TIMESTAMP) + to_days((event_id % 365)::INT) AS t FROM events)""",
)
def f10(spark, sf_dir):
    """Events moved over a year, so that both of a zone's offsets occur."""
    e = corpus.read(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 365 * 86400
    ns = seconds * 1_000_000_000
    return e.select("event_id", times.local_clock(ns, "Europe/Berlin").alias("local"), times.offset_minutes(ns, "Europe/Berlin").alias("offset_minutes"))


@query(
    "f28_utc_or_null",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 2 THEN t - 7200 ELSE t END AS seconds FROM (SELECT event_id, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT AS t FROM events)""",
)
def f28(spark, sf_dir):
    """The same instant in four forms, and something else."""
    e = corpus.read(spark, sf_dir, "events")
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    plain = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(F.lit(" "), plain, F.lit(" "))).when(k == 2, F.concat(plain, F.lit("+02:00"))).when(k == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return e.select("event_id", F.unix_seconds(times.utc_or_null(text)).alias("seconds"))


@query("x20_date_order", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DMY' WHEN 1 THEN 'MDY' ELSE 'ambiguous' END AS date_order FROM events")
def x20(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events")
    probe = F.get(F.array(*[F.lit(x) for x in ("14.08.2024", " 8/14/2024", "2024-08-14", "no date")]), (F.col("event_id") % 4).cast("int"))
    return e.select("event_id", times.date_order(probe).alias("date_order"))
