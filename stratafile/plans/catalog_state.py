"""Queries on current state, history and run retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state
from ..sources import corpus
from . import history
from .registry import query

SHOWN = "file_id, root_id, state, obs AS current_observation_id, run AS current_run_id, first_run AS first_run_id, changed_run AS state_changed_run_id, size_bytes, sha AS sha256, content_obs AS content_observation_id, content_run AS content_run_id"
COLUMNS = ["file_id", "root_id", "state", "current_observation_id", "current_run_id", "first_run_id", "state_changed_run_id", "size_bytes", "sha256", "content_observation_id", "content_run_id"]

for _run in (1, 2, 3):

    @query(f"i1s_state_after_run{_run}", f"SELECT {SHOWN} FROM state{_run}")
    def i1s(spark, sf_dir, run=_run):
        return history.after(spark, sf_dir, run)[0].select(*COLUMNS)


@query("i2s_observations", "SELECT observation_id, run_id, file_id, root_id, change_kind, supersedes_observation_id, size_bytes FROM observations")
def i2s(spark, sf_dir):
    return history.after(spark, sf_dir, 3)[1]


@query("i2s_scan_summary", "SELECT run_id, root_id, change_kind, count(*) AS observations FROM observations GROUP BY ALL")
def i2s_summary(spark, sf_dir):
    return history.after(spark, sf_dir, 3)[1].groupBy("run_id", "root_id", "change_kind").agg(F.count("*").alias("observations"))


for _run in (2, 3):

    @query(
        f"a4_state_summary_run{_run}",
        f"""SELECT count(*) FILTER (state = 'present') AS present, count(*) FILTER (state = 'inaccessible') AS inaccessible, count(*) FILTER (state = 'missing') AS missing,
          count(*) FILTER (state = 'unverified') AS unverified, count(*) FILTER (state = 'present' AND sha IS NOT NULL AND (content_obs IS NULL OR content_obs <> obs)) AS stale_content, count(*) AS total FROM state{_run}""",
    )
    def a4(spark, sf_dir, run=_run):
        return state.summary(history.after(spark, sf_dir, run)[0])


@query("p8_stale_content_run2", "SELECT file_id, content_obs AS content_observation_id, obs AS current_observation_id FROM state2 WHERE state = 'present' AND sha IS NOT NULL AND (content_obs IS NULL OR content_obs <> obs)")
def p8(spark, sf_dir):
    return state.stale(history.after(spark, sf_dir, 2)[0]).select("file_id", "content_observation_id", "current_observation_id")


@query("p15_changed_in_run2", "SELECT file_id FROM state2 WHERE kind = 'modified'")
def p15(spark, sf_dir):
    before, _ = history.after(spark, sf_dir, 1)
    now = history.records(history.snapshot(spark, sf_dir, 2))
    rows = before.alias("a").join(now.alias("b"), F.col("a.file_id") == F.col("b.file_id"))
    return rows.where((F.col("a.state") == "present") & (F.col("b.status") == "observed") & state.differs("a", "b")).select(F.col("a.file_id").alias("file_id"))


@query("u1_vanished_in_run2", "SELECT file_id, relative_path FROM state1 WHERE state IN ('present', 'inaccessible') AND file_id NOT IN (SELECT file_id FROM snap2)")
def u1(spark, sf_dir):
    before, _ = history.after(spark, sf_dir, 1)
    return before.where("state in ('present', 'inaccessible')").join(history.snapshot(spark, sf_dir, 2).select("file_id"), "file_id", "left_anti").select("file_id", "relative_path")


@query("j8_missing_since", "SELECT file_id, changed_run AS missing_since_run FROM state2 WHERE state = 'missing'")
def j8(spark, sf_dir):
    return history.after(spark, sf_dir, 2)[0].where("state = 'missing'").select("file_id", F.col("state_changed_run_id").alias("missing_since_run"))


@query("u2_new_in_run2", "SELECT file_id, root_id, relative_path FROM state2 WHERE first_run = 2")
def u2(spark, sf_dir):
    return history.after(spark, sf_dir, 2)[0].where("first_run_id = 2").select("file_id", "root_id", "relative_path")


@query(
    "j19_snapshot_diff",
    """SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'removed' WHEN a.size_bytes IS DISTINCT FROM b.size_bytes THEN 'resized' ELSE 'kept' END AS diff
    FROM snap1 a FULL OUTER JOIN snap2 b ON a.file_id = b.file_id""",
)
def j19(spark, sf_dir):
    one, two = (history.records(history.snapshot(spark, sf_dir, r)).select("file_id", "size_bytes").alias(n) for r, n in ((1, "a"), (2, "b")))
    rows = one.join(two, F.col("a.file_id") == F.col("b.file_id"), "full_outer")
    diff = F.when(F.col("a.file_id").isNull(), "added").when(F.col("b.file_id").isNull(), "removed").when(~F.col("a.size_bytes").eqNullSafe(F.col("b.size_bytes")), "resized").otherwise("kept")
    return rows.select(F.coalesce("a.file_id", "b.file_id").alias("file_id"), diff.alias("diff"))


RUNS = "(VALUES (1), (2), (3)) t(run_id)"


def _runs(spark):
    return spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-03-01")], "run_id int, started_utc string")


@query(
    "i6s_compaction_keep_set",
    """SELECT observation_id FROM observations WHERE NOT (run_id < 2
      AND observation_id NOT IN (SELECT obs FROM state3 WHERE obs IS NOT NULL) AND observation_id NOT IN (SELECT content_obs FROM state3 WHERE content_obs IS NOT NULL)
      AND observation_id NOT IN (SELECT observation_id FROM observations WHERE file_id % 23 = 0)
      AND observation_id NOT IN (SELECT supersedes_observation_id FROM observations WHERE supersedes_observation_id IS NOT NULL AND run_id >= 2))""",
)
def i6s(spark, sf_dir):
    now, log = history.after(spark, sf_dir, 3)
    members = log.where("file_id % 23 = 0").select("observation_id")
    removed = state.compacted(log, now, members, _runs(spark), 2)
    return log.join(removed.select("observation_id"), "observation_id", "left_anti").select("observation_id")


@query(
    "j9_compaction_removed",
    """SELECT observation_id FROM observations WHERE run_id < 3 AND observation_id NOT IN (SELECT obs FROM state3 WHERE obs IS NOT NULL)
      AND observation_id NOT IN (SELECT content_obs FROM state3 WHERE content_obs IS NOT NULL)
      AND observation_id NOT IN (SELECT supersedes_observation_id FROM observations WHERE supersedes_observation_id IS NOT NULL AND run_id >= 3)""",
)
def j9(spark, sf_dir):
    now, log = history.after(spark, sf_dir, 3)
    return state.compacted(log, now, log.limit(0).select("observation_id"), _runs(spark), 1).select("observation_id")


@query("u3_runs_outside_retention", "SELECT run_id FROM (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS k FROM (SELECT DISTINCT run_id FROM observations)) WHERE k > 2")
def u3(spark, sf_dir):
    runs = history.after(spark, sf_dir, 3)[1].select("run_id").distinct()
    return runs.join(runs.orderBy(F.desc("run_id")).limit(2), "run_id", "left_anti")


@query("a24_history_footprint", "SELECT run_id, count(*) AS observations, count(DISTINCT file_id) AS locations, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM observations GROUP BY run_id")
def a24(spark, sf_dir):
    log = history.after(spark, sf_dir, 3)[1]
    return log.groupBy("run_id").agg(F.count("*").alias("observations"), F.countDistinct("file_id").alias("locations"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query(
    "w8_supersedes_chain",
    "SELECT observation_id, lag(observation_id) OVER (PARTITION BY file_id ORDER BY run_id) AS supersedes_observation_id FROM observations",
)
def w8(spark, sf_dir):
    log = history.after(spark, sf_dir, 3)[1].select("observation_id", "file_id", "run_id")
    return log.select("observation_id", F.lag("observation_id").over(Window.partitionBy("file_id").orderBy("run_id")).alias("supersedes_observation_id"))


@query(
    "w9_last_two_observations",
    "SELECT file_id, observation_id, place FROM (SELECT file_id, observation_id, row_number() OVER (PARTITION BY file_id ORDER BY run_id DESC) AS place FROM observations) WHERE place <= 2",
)
def w9(spark, sf_dir):
    return state.last_observations(history.after(spark, sf_dir, 3)[1]).select("file_id", "observation_id", "place")


@query("a19_inventory_counts", "SELECT count(DISTINCT run_id || ':' || root_id) AS scans, count(DISTINCT file_id) AS paths, count(*) AS observations, count(*) FILTER (change_kind = 'inaccessible' OR size_bytes IS NULL) AS inaccessible FROM observations")
def a19(spark, sf_dir):
    log = history.after(spark, sf_dir, 3)[1]
    return log.agg(F.countDistinct("run_id", "root_id").alias("scans"), F.countDistinct("file_id").alias("paths"), F.count("*").alias("observations"), F.count_if((F.col("change_kind") == "inaccessible") | F.col("size_bytes").isNull()).alias("inaccessible"))


@query("j7_scanned_in_run3", "SELECT file_id FROM state3 WHERE root_id IN (SELECT root_id FROM observations WHERE run_id = 3)")
def j7(spark, sf_dir):
    now, log = history.after(spark, sf_dir, 3)
    return now.join(log.where("run_id = 3").select("root_id").distinct(), "root_id", "left_semi").select("file_id")


@query("i7s_content_last_seen", "SELECT sha256, max(run_id) AS last_seen_run, count(DISTINCT run_id) AS runs, count(*) AS measurements FROM (SELECT 1 AS run_id, upper(sha256(content)) AS sha256 FROM snap1 WHERE NOT inaccessible UNION ALL SELECT 3, upper(sha256(content)) FROM snap3 WHERE NOT inaccessible) GROUP BY sha256")
def i7s(spark, sf_dir):
    both = [history.digests(history.snapshot(spark, sf_dir, r)).withColumn("run_id", F.lit(r)) for r in (1, 3)]
    return both[0].unionByName(both[1]).groupBy("sha256").agg(F.max("run_id").alias("last_seen_run"), F.countDistinct("run_id").alias("runs"), F.count("*").alias("measurements"))


@query("x1_location_ids", "SELECT file_id, root_id, path_sort_key, first_run AS first_run_id FROM state3")
def x1(spark, sf_dir):
    return history.after(spark, sf_dir, 3)[0].select("file_id", "root_id", "path_sort_key", "first_run_id")


@query("x6_full_history_run2", "SELECT coalesce(kind, 'verified') AS change_kind, count(*) AS observations FROM state2 WHERE kind IS NOT NULL OR file_id IN (SELECT file_id FROM snap2) GROUP BY 1")
def x6(spark, sf_dir):
    before, _ = history.after(spark, sf_dir, 1)
    rows = history.snapshot(spark, sf_dir, 2)
    _, seen = state.fold(before, history.records(rows), 2, [1, 2], keep_verified=True)
    return seen.groupBy("change_kind").agg(F.count("*").alias("observations"))


@query(
    "x26_root_coverage",
    "SELECT r.root_id, run_id, coalesce(o.n > 0, false) AS was_scanned, coalesce(o.n, 0) AS observations FROM roots r CROSS JOIN (VALUES (1), (2), (3)) t(run_id) LEFT JOIN (SELECT root_id AS rid, run_id AS k, count(*) AS n FROM observations GROUP BY ALL) o ON o.rid = r.root_id AND o.k = run_id WHERE r.root_id IN (1, 2)",
)
def x26(spark, sf_dir):
    log = history.after(spark, sf_dir, 3)[1].groupBy("root_id", "run_id").agg(F.count("*").alias("n"))
    wanted = corpus.roots(spark).where("root_id in (1, 2)").select("root_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("run_id"))
    rows = wanted.join(log, ["root_id", "run_id"], "left")
    return rows.select("root_id", "run_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("was_scanned"), F.coalesce("n", F.lit(0)).alias("observations"))


@query(
    "v1_unique_keys",
    """SELECT 'location' AS rule, (SELECT count(*) - count(DISTINCT file_id) FROM state3) AS violations
    UNION ALL SELECT 'observation', (SELECT count(*) - count(DISTINCT observation_id) FROM observations)
    UNION ALL SELECT 'path', (SELECT count(*) - count(DISTINCT root_id || ':' || path_sort_key) FROM state3)""",
)
def v1(spark, sf_dir):
    now, log = history.after(spark, sf_dir, 3)
    checks = [(now, ["file_id"], "location"), (log, ["observation_id"], "observation"), (now, ["root_id", "path_sort_key"], "path")]
    out = None
    for df, key, name in checks:
        one = state.validate(df, key, name)
        out = one if out is None else out.unionByName(one)
    return out
