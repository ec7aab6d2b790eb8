"""Queries on steps that other queries contain: each operator by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attrs, paths
from ..operators import hashing
from ..operators.state import RUN_SPAN
from ..sources import corpus
from . import history
from .catalog_content import entries
from .registry import query


@query("k9_state_changed_rows", "SELECT file_id, state, obs AS current_observation_id, changed_run AS state_changed_run_id, kind AS change_kind FROM state2 WHERE kind IS NOT NULL")
def k9(spark, sf_dir):
    """Rows with a new observation: the state's own date moves only where the state does."""
    now, log = history.after(spark, sf_dir, 2)
    kinds = log.where("run_id = 2").select(F.col("observation_id").alias("current_observation_id"), "change_kind")
    return now.join(kinds, "current_observation_id").select("file_id", "state", "current_observation_id", "state_changed_run_id", "change_kind")


@query("k10_state_unchanged_rows", "SELECT file_id, state, obs AS current_observation_id, run AS current_run_id, first_run AS first_run_id, size_bytes FROM state2 WHERE kind IS NULL AND run = 2 AND state <> 'missing'")
def k10(spark, sf_dir):
    """Rows that the run saw unchanged: the run is refreshed, the observation stays."""
    now, _ = history.after(spark, sf_dir, 2)
    same = now.where((F.col("current_run_id") == 2) & (F.col("state") != "missing") & (F.col("current_observation_id") < 2 * RUN_SPAN))
    return same.select("file_id", "state", "current_observation_id", "current_run_id", "first_run_id", "size_bytes")


MEASURED = "(SELECT 1 AS run_id, file_id, upper(sha256(content)) AS sha256 FROM snap1 WHERE NOT inaccessible UNION ALL SELECT 3, file_id, upper(sha256(content)) FROM snap3 WHERE NOT inaccessible)"


def measured(spark, sf_dir):
    parts = [history.digests(history.snapshot(spark, sf_dir, r)).select(F.lit(r).alias("run_id"), "file_id", "sha256") for r in (1, 3)]
    return parts[0].unionByName(parts[1])


@query("j5_historical_star", f"SELECT m.sha256, o.run_id, o.observation_id, o.change_kind, f.relative_path FROM {MEASURED} m JOIN observations o ON o.file_id = m.file_id AND o.run_id = m.run_id JOIN files f ON f.file_id = m.file_id")
def j5(spark, sf_dir):
    """Content, measurement, the observation it measured, and the path."""
    _, log = history.after(spark, sf_dir, 3)
    rows = measured(spark, sf_dir).join(log.select("file_id", "run_id", "observation_id", "change_kind"), ["file_id", "run_id"])
    return rows.join(corpus.files(spark, sf_dir, (1, 2)).select("file_id", "relative_path"), "file_id").select("sha256", "run_id", "observation_id", "change_kind", "relative_path")


@query(
    "j6_latest_measurement_of_run",
    f"""SELECT * FROM (WITH tries AS (SELECT run_id, file_id, sha256, run_id * 10 + k AS measurement_id, CASE WHEN k = 2 AND file_id % 3 = 0 THEN NULL ELSE sha256 END AS told FROM {MEASURED}, (VALUES (1), (2)) t(k))
    SELECT o.observation_id, (SELECT arg_max(t.told IS NULL, t.measurement_id) FROM tries t WHERE t.file_id = o.file_id AND t.run_id = o.run_id) AS failed,
      (SELECT max(t.measurement_id) FROM tries t WHERE t.file_id = o.file_id AND t.run_id = o.run_id) AS measurement_id FROM observations o)""",
)
def j6(spark, sf_dir):
    """For every observation the last of its run's measurements of it; each file was measured twice, every third failed the second time."""
    _, log = history.after(spark, sf_dir, 3)
    tries = measured(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    tries = tries.select("run_id", "file_id", (F.col("run_id") * 10 + F.col("k")).alias("measurement_id"), ((F.col("k") == 2) & (F.col("file_id") % 3 == 0)).alias("failed"))
    last = tries.groupBy("run_id", "file_id").agg(F.max_by("failed", "measurement_id").alias("failed"), F.max("measurement_id").alias("measurement_id"))
    return log.join(last, ["run_id", "file_id"], "left").select("observation_id", "failed", "measurement_id")


@query("a6_size_candidates_ranked", "SELECT h.file_id, s.size_group_id, s.members FROM hashable h JOIN cand_sizes s ON h.size_bytes = s.size_bytes WHERE NOT h.cloud")
def a6(spark, sf_dir):
    e = entries(spark, sf_dir).where(~F.col("cloud")).select("file_id", "size_bytes", "ord")
    return e.join(hashing.size_groups(e), "size_bytes").select("file_id", "size_group_id", "members")


@query("a8_final_verdicts_w64", "SELECT file_id, final_status, duplicate_group_id FROM selective", window=64)
def a8(spark, sf_dir):
    return hashing.selective(entries(spark, sf_dir), 64).select("file_id", "final_status", "duplicate_group_id")


@query("w2_partial_group_order_w64", "SELECT partial_group_id, min(size_group_id) AS size_group_id, count(*) AS members FROM selective WHERE partial_group_id IS NOT NULL GROUP BY 1", window=64)
def w2(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64).where("partial_group_id is not null")
    return r.groupBy("partial_group_id").agg(F.min("size_group_id").alias("size_group_id"), F.count("*").alias("members"))


@query("w3_duplicate_group_order_w64", "SELECT duplicate_group_id, min(partial_group_id) AS partial_group_id, count(full_hash) > 0 AS by_full_hash FROM selective WHERE duplicate_group_id IS NOT NULL GROUP BY 1", window=64)
def w3(spark, sf_dir):
    """Groups that the first bytes confirm come first, then those that needed the whole file."""
    r = hashing.selective(entries(spark, sf_dir), 64).where("duplicate_group_id is not null")
    return r.groupBy("duplicate_group_id").agg(F.min("partial_group_id").alias("partial_group_id"), (F.count("full_hash") > 0).alias("by_full_hash"))


@query(
    "w4_exhaustive_group_order",
    "SELECT full_hash, row_number() OVER (ORDER BY min(ord)) AS duplicate_group_id, count(*) AS members FROM (SELECT ord, upper(sha256(content)) AS full_hash FROM hashable WHERE NOT cloud) GROUP BY full_hash HAVING count(*) > 1",
)
def w4(spark, sf_dir):
    r = hashing.exhaustive(entries(spark, sf_dir)).where("duplicate_group_id is not null")
    return r.groupBy("full_hash", "duplicate_group_id").agg(F.count("*").alias("members"))


@query(
    "u4_inventory_of_run",
    "SELECT f.file_id, f.root_ordinal, f.relative_path, o.run_id FROM observations o JOIN files f ON f.file_id = o.file_id WHERE o.run_id = 1 UNION ALL SELECT f.file_id, f.root_ordinal, f.relative_path, o.run_id FROM observations o JOIN files f ON f.file_id = o.file_id WHERE o.run_id = 2",
)
def u4(spark, sf_dir):
    """What all scans of a run, one for each root, have observed, for the runs that had more than one scan."""
    _, log = history.after(spark, sf_dir, 3)
    scans = log.select("run_id", "root_id").distinct()
    runs = scans.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1").select("run_id")
    f = corpus.files(spark, sf_dir, (1, 2)).select("file_id", "root_ordinal", "relative_path")
    return log.join(runs, "run_id", "left_semi").select("file_id", "run_id").join(f, "file_id").select("file_id", "root_ordinal", "relative_path", "run_id")


@query("f1_extensions", r"SELECT file_id, CASE WHEN strpos(file_name, '.') = 0 OR ends_with(file_name, '.') THEN '' ELSE '.' || string_split(file_name, '.')[-1] END AS extension FROM files")
def f1(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.select("file_id", paths.extension(F.col("file_name")).alias("extension"))


@query("f4_sort_keys", r"SELECT file_id, replace(lower(replace(relative_path, '/', '\')), '\', chr(0)) AS sort_key FROM files".replace("\\\\", "\\"))
def f4(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_id", paths.sort_key(F.col("relative_path")).alias("sort_key"))


@query("f6_utf16_lengths", "SELECT file_id, (length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS units FROM files WHERE NOT inaccessible")
def f6(spark, sf_dir):
    """Code units of whole texts: a character beyond the first plane takes two."""
    return corpus.raw(spark, sf_dir).where(~F.col("inaccessible")).select("file_id", paths.utf16_length(F.col("text")).alias("units"))


@query(
    "f8_attribute_tests",
    """SELECT file_id, attribute_word & 33 = 33 AS read_only_archive, (attribute_word & 4096 <> 0 OR attribute_word & 262144 <> 0 OR attribute_word & 4194304 <> 0) AS cloud,
      file_id % 4 = 0 AND file_id % 3 IN (0, 1) AS true_link FROM files""",
)
def f8(spark, sf_dir):
    """Every fourth file is made a reparse point; its tag is a junction's, a symbolic link's or another."""
    raw = corpus.raw(spark, sf_dir).select("file_id", "attribute_word")
    k = F.col("file_id")
    tag = F.when(k % 3 == 0, F.lit(attrs.LINK_TAGS[0])).when(k % 3 == 1, F.lit(attrs.LINK_TAGS[1])).otherwise(F.lit(0x9000601A))
    word = F.col("attribute_word").bitwiseOR(F.when(k % 4 == 0, attrs.REPARSE).otherwise(0))
    return raw.select("file_id", attrs.has_all(F.col("attribute_word"), 33).alias("read_only_archive"), attrs.is_cloud(F.col("attribute_word")).alias("cloud"), attrs.is_true_link(word, tag).alias("true_link"))
