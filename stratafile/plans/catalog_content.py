"""Queries on content identity and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import duplicates, hashing
from ..operators.ranking import first_of, numbered
from ..sources import corpus
from ..sources.store import once
from . import history
from .registry import query


def entries(spark: SparkSession, sf_dir: str, only: tuple[int, ...] = (1,)) -> DataFrame:
    return hashing.entries(corpus.raw(spark, sf_dir, only))


def hashed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots 1 and 2, everything present and freshly digested, as the scan stored it. The digest is part of the scan; bodies go no further."""
    return once(spark, ("hashed-state", sf_dir), lambda: _hashed_state(spark, sf_dir))


def _hashed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.raw(spark, sf_dir, (1, 2)).where(~F.col("inaccessible"))
    sha = rows.withColumn("sha256", hashing.digest(F.col("text")))
    ordinal = F.when(F.col("root_id") == 1, 1).otherwise(2)
    return sha.select(
        "file_id", "root_id", ordinal.alias("root_ordinal"), "relative_path", paths.sort_key(F.col("relative_path")).alias("path_sort_key"), F.octet_length("text").cast("long").alias("size_bytes"),
        "volume_serial", "file_index", "sha256", F.lit("present").alias("state"), F.lit(1).alias("current_observation_id"), F.lit(1).alias("content_observation_id"),
    )


SETS = "sha256, size_bytes, location_count, root_count, physical_copy_count, hard_link_alias_count, physical_identity_complete, reclaimable_bytes"


@query("a1_current_duplicate_sets", f"SELECT {SETS} FROM dup_sets")
def a1(spark, sf_dir):
    return duplicates.current_sets(hashed_state(spark, sf_dir))


@query("x8_current_duplicate_sets_min3", f"SELECT {SETS} FROM dup_sets WHERE location_count >= 3")
def x8(spark, sf_dir):
    return duplicates.current_sets(hashed_state(spark, sf_dir), 3)


@query(
    "a1_after_run3",
    """SELECT sha AS sha256, max(size_bytes) AS size_bytes, count(*) AS location_count, count(DISTINCT root_id) AS root_count,
      CASE WHEN count(file_index) = count(*) THEN count(DISTINCT volume_serial || ':' || file_index) END AS physical_copy_count
    FROM state3 WHERE state = 'present' AND sha IS NOT NULL AND content_obs = obs GROUP BY sha HAVING count(*) > 1""",
)
def a1_run3(spark, sf_dir):
    return duplicates.current_sets(history.after(spark, sf_dir, 3)[0]).select("sha256", "size_bytes", "location_count", "root_count", "physical_copy_count")


@query(
    "a2_historical_duplicate_sets",
    """SELECT sha256, max(size_bytes) AS size_bytes, count(DISTINCT file_id) AS location_count FROM (
      SELECT file_id, strlen(content) AS size_bytes, upper(sha256(content)) AS sha256 FROM snap1 WHERE NOT inaccessible
      UNION ALL SELECT file_id, strlen(content), upper(sha256(content)) FROM snap3 WHERE NOT inaccessible) GROUP BY sha256 HAVING count(DISTINCT file_id) > 1""",
)
def a2(spark, sf_dir):
    measured = None
    for run in (1, 3):
        rows = history.snapshot(spark, sf_dir, run).where(~F.col("inaccessible"))
        part = rows.select("file_id", F.octet_length("text").cast("long").alias("size_bytes"), hashing.digest(F.col("text")).alias("sha256"))
        measured = part if measured is None else measured.unionByName(part)
    return duplicates.historical_sets(measured)


@query("a3_cross_root_duplicates", f"SELECT {SETS} FROM dup_sets WHERE root_count > 1")
def a3(spark, sf_dir):
    return duplicates.current_sets(hashed_state(spark, sf_dir)).where("root_count > 1")


@query(
    "w5_member_rank",
    """SELECT p.sha256, file_id, root_id, relative_path, row_number() OVER (PARTITION BY p.sha256 ORDER BY root_ordinal, path_sort_key, file_id) AS member_rank
    FROM present p JOIN dup_sets d ON p.sha256 = d.sha256""",
)
def w5(spark, sf_dir):
    return duplicates.member_rank(hashed_state(spark, sf_dir))


@query("u5_locations_of_content", "SELECT DISTINCT p.sha256, root_id, relative_path FROM present p JOIN dup_sets d ON p.sha256 = d.sha256")
def u5(spark, sf_dir):
    return duplicates.member_rank(hashed_state(spark, sf_dir)).select("sha256", "root_id", "relative_path").distinct()


for _name, _skip in (("w1_size_groups", False), ("w1_size_groups_skip_cloud", True)):

    @query(_name, "SELECT size_bytes, members, reclaim, size_group_id FROM cand_sizes", skip_cloud=_skip)
    def w1(spark, sf_dir, skip=_skip):
        files = entries(spark, sf_dir).drop("text", "walk")
        return hashing.size_groups(files.where(~F.col("cloud")) if skip else files)


RESULT = "file_id, size_bytes, size_group_id, partial_hash, partial_group_id, partial_status, full_hash, final_status, duplicate_group_id"
for _name, _window, _skip in (("a10_selective_default", 65536, True), ("a10_selective_w64", 64, True), ("a10_selective_w64_with_cloud", 64, False)):

    @query(_name, f"SELECT {RESULT} FROM selective", window=_window, skip_cloud=_skip)
    def a10(spark, sf_dir, window=_window, skip=_skip):
        return hashing.selective(entries(spark, sf_dir), window, skip)


@query(
    "a11_outcome_summary_w64",
    """SELECT final_status, count(*) AS files, count(partial_hash) AS partial_hashed, count(full_hash) AS full_hashed,
      coalesce(sum(CASE WHEN partial_hash IS NOT NULL THEN least(size_bytes, 64) END), 0)::BIGINT AS partial_bytes, coalesce(sum(CASE WHEN full_hash IS NOT NULL THEN size_bytes END), 0)::BIGINT AS full_bytes
    FROM selective GROUP BY final_status""",
    window=64,
)
def a11(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    read = lambda c, n: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), n)), F.lit(0)).cast("long")
    return r.groupBy("final_status").agg(F.count("*").alias("files"), F.count("partial_hash").alias("partial_hashed"), F.count("full_hash").alias("full_hashed"), read("partial_hash", F.least("size_bytes", F.lit(64))).alias("partial_bytes"), read("full_hash", F.col("size_bytes")).alias("full_bytes"))


@query(
    "a5_duplicate_run_totals_w64",
    """SELECT count(size_group_id) AS candidates, count(DISTINCT size_group_id) AS size_groups, count(*) FILTER (partial_status = 'NeedsFullHash') AS needs_full,
      count(*) FILTER (final_status = 'RuledOutByFullHash') AS ruled_out_full, count(*) FILTER (final_status = 'Error') AS errors, count(DISTINCT duplicate_group_id) AS groups_found,
      count(duplicate_group_id) AS members, count(duplicate_group_id) - count(DISTINCT duplicate_group_id) AS redundant FROM selective""",
    window=64,
)
def a5(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    d = "duplicate_group_id"
    return r.agg(
        F.count("size_group_id").alias("candidates"), F.countDistinct("size_group_id").alias("size_groups"), F.count_if(F.col("partial_status") == "NeedsFullHash").alias("needs_full"),
        F.count_if(F.col("final_status") == "RuledOutByFullHash").alias("ruled_out_full"), F.count_if(F.col("final_status") == "Error").alias("errors"),
        F.countDistinct(d).alias("groups_found"), F.count(d).alias("members"), (F.count(d) - F.countDistinct(d)).alias("redundant"),
    )


@query(
    "a12_duplicate_groups_w64",
    """SELECT duplicate_group_id, count(*) AS member_count, count(*) - 1 AS redundant_count, max(size_bytes) * (count(*) - 1) AS reclaimable_bytes,
      CASE WHEN max(full_hash) IS NOT NULL THEN 'FullHash' ELSE 'PartialHash' END AS method FROM selective WHERE duplicate_group_id IS NOT NULL GROUP BY duplicate_group_id""",
    window=64,
)
def a12(spark, sf_dir):
    return hashing.duplicate_groups(hashing.selective(entries(spark, sf_dir), 64))


@query(
    "a9_exhaustive",
    """SELECT r.file_id, r.size_bytes, r.full_hash, CASE WHEN r.full_hash IS NULL THEN 'SkippedCloudOnly' WHEN g.id IS NULL THEN 'UniqueByHash' ELSE 'ConfirmedDuplicate' END AS final_status, g.id AS duplicate_group_id
    FROM (SELECT file_id, size_bytes, CASE WHEN NOT cloud THEN upper(sha256(content)) END AS full_hash FROM hashable) r
    LEFT JOIN (SELECT full_hash, row_number() OVER (ORDER BY min(ord)) AS id FROM (SELECT ord, upper(sha256(content)) AS full_hash FROM hashable WHERE NOT cloud) GROUP BY full_hash HAVING count(*) > 1) g ON r.full_hash = g.full_hash""",
)
def a9(spark, sf_dir):
    return hashing.exhaustive(entries(spark, sf_dir))


@query("s5_window_digest", "SELECT file_id, upper(sha256(encode(content)[1:4096])) AS digest, least(size_bytes, 4096) AS bytes_read FROM files WHERE NOT inaccessible")
def s5(spark, sf_dir):
    rows = corpus.raw(spark, sf_dir).where(~F.col("inaccessible"))
    return rows.select("file_id", hashing.digest(F.col("text"), 4096).alias("digest"), F.least(F.octet_length("text").cast("long"), F.lit(4096).cast("long")).alias("bytes_read"))


@query("s6_full_digest", "SELECT file_id, upper(sha256(content)) AS digest FROM files WHERE NOT inaccessible")
def s6(spark, sf_dir):
    return corpus.raw(spark, sf_dir).where(~F.col("inaccessible")).select("file_id", hashing.digest(F.col("text")).alias("digest"))


@query("s3_hash_inputs", "SELECT file_id, root_ordinal, relative_path, size_bytes, cloud AS is_offline_or_cloud FROM files WHERE NOT inaccessible AND root_id IN (1, 3)")
def s3(spark, sf_dir):
    return corpus.files(spark, sf_dir, (1, 3)).where("status = 'observed'").select("file_id", "root_ordinal", "relative_path", "size_bytes", "is_offline_or_cloud")


@query("p9_size_candidates", "SELECT file_id, size_bytes FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes) AS n FROM files WHERE NOT inaccessible) WHERE n > 1")
def p9(spark, sf_dir):
    f = corpus.files(spark, sf_dir).where("status = 'observed'").select("file_id", "size_bytes")
    return f.join(f.groupBy("size_bytes").count().where("count > 1"), "size_bytes", "left_semi").select("file_id", "size_bytes")


@query("p10_cloud_only_excluded", "SELECT file_id, relative_path, 'skipped_cloud_only' AS hash_status FROM files WHERE cloud AND NOT inaccessible")
def p10(spark, sf_dir):
    return corpus.files(spark, sf_dir).where("is_offline_or_cloud and status = 'observed'").select("file_id", "relative_path", hashing.stored_status(F.lit("SkippedCloudOnly")).alias("hash_status"))


@query(
    "p12_identity_classes_w64",
    """SELECT file_id, CASE WHEN full_hash IS NOT NULL THEN full_hash WHEN partial_hash IS NOT NULL AND size_bytes <= 64 THEN partial_hash END AS sha256,
      CASE WHEN full_hash IS NOT NULL THEN 'full_hash' WHEN partial_hash IS NOT NULL AND size_bytes <= 64 THEN 'partial_hash_complete' END AS identity_source FROM selective""",
    window=64,
)
def p12(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    sha, source = hashing.identity(F.col("full_hash"), F.col("partial_hash"), F.col("size_bytes"), 64)
    return r.select("file_id", sha.alias("sha256"), source.alias("identity_source"))


@query(
    "p13_stored_status_w64",
    """SELECT CASE final_status WHEN 'UniqueBySize' THEN 'size_unique' WHEN 'RuledOutByPartialHash' THEN 'ruled_out_partial' WHEN 'RuledOutByFullHash' THEN 'ruled_out_full'
      WHEN 'ConfirmedDuplicate' THEN 'confirmed_duplicate' WHEN 'SkippedCloudOnly' THEN 'skipped_cloud_only' ELSE 'unknown' END AS hash_status, count(*) AS files FROM selective GROUP BY 1""",
    window=64,
)
def p13(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    return r.groupBy(hashing.stored_status(F.col("final_status")).alias("hash_status")).agg(F.count("*").alias("files"))


@query(
    "p4_partial_status_rebuilt_w64",
    """SELECT file_id, CASE WHEN final_status IN ('UniqueBySize', 'SkippedCloudOnly') THEN NULL WHEN final_status = 'RuledOutByPartialHash' THEN 'RuledOut'
      WHEN full_hash IS NOT NULL THEN 'NeedsFullHash' ELSE 'ConfirmedDuplicate' END AS partial_status FROM selective""",
    window=64,
)
def p4(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    s = F.col("final_status")
    rebuilt = F.when(s.isin("UniqueBySize", "SkippedCloudOnly"), None).when(s == "RuledOutByPartialHash", "RuledOut").when(F.col("full_hash").isNotNull(), "NeedsFullHash").otherwise("ConfirmedDuplicate")
    return r.select("file_id", rebuilt.alias("partial_status"))


@query("k12_content_first_writer", "SELECT sha256, min(file_id) AS first_file_id, min(size_bytes) AS size_bytes, min(size_bytes) <> max(size_bytes) AS size_mismatch FROM present GROUP BY sha256")
def k12(spark, sf_dir):
    s = hashed_state(spark, sf_dir)
    return s.groupBy("sha256").agg(F.min("file_id").alias("first_file_id"), F.min("size_bytes").alias("size_bytes"), (F.min("size_bytes") != F.max("size_bytes")).alias("size_mismatch"))


@query(
    "k11_measurement_refinement",
    """SELECT s.file_id, coalesce(f.full_hash, s.full_hash) AS full_hash, s.partial_hash, CASE WHEN f.full_hash IS NOT NULL THEN 'unique_by_hash' ELSE s.final_status END AS hash_status
    FROM selective s LEFT JOIN (SELECT file_id, upper(sha256(content)) AS full_hash FROM hashable WHERE file_id % 2 = 0) f ON s.file_id = f.file_id""",
    window=64,
)
def k11(spark, sf_dir):
    """Two passes over one key: known values stay unless the later pass has one; the status is always the later pass's."""
    e = entries(spark, sf_dir)
    first = hashing.selective(e, 64).select("file_id", F.lit(1).alias("turn"), "full_hash", "partial_hash", F.col("final_status").alias("hash_status"))
    second = e.where("file_id % 2 = 0").select("file_id", F.lit(2).alias("turn"), hashing.digest(F.col("text")).alias("full_hash"), F.lit(None).cast("string").alias("partial_hash"), F.lit("unique_by_hash").alias("hash_status"))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
    return first.unionByName(second).groupBy("file_id").agg(known("full_hash"), known("partial_hash"), known("hash_status"))


@query(
    "w11_report_groups_w64",
    """SELECT report_rank, duplicate_group_id, reclaimable_bytes, path_rank, relative_path FROM (
      SELECT g.report_rank, g.duplicate_group_id, g.reclaimable_bytes, h.relative_path, row_number() OVER (PARTITION BY g.duplicate_group_id ORDER BY h.path_sort_key, h.file_id) AS path_rank
      FROM (SELECT duplicate_group_id, max(size_bytes) * (count(*) - 1) AS reclaimable_bytes, row_number() OVER (ORDER BY max(size_bytes) * (count(*) - 1) DESC, duplicate_group_id) AS report_rank
        FROM selective WHERE duplicate_group_id IS NOT NULL GROUP BY duplicate_group_id) g
      JOIN selective s ON s.duplicate_group_id = g.duplicate_group_id JOIN hashable h ON h.file_id = s.file_id WHERE g.report_rank <= 20) WHERE path_rank <= 5""",
    window=64,
)
def w11(spark, sf_dir):
    e = entries(spark, sf_dir)
    r = hashing.selective(e, 64)
    top = hashing.duplicate_groups(r).orderBy(F.desc("reclaimable_bytes"), "duplicate_group_id").limit(20)
    top = top.select("duplicate_group_id", "reclaimable_bytes", F.row_number().over(Window.orderBy(F.desc("reclaimable_bytes"), "duplicate_group_id")).alias("report_rank"))
    rows = r.join(F.broadcast(top), "duplicate_group_id").join(e.select("file_id", "relative_path", F.col("ord")["s"].alias("s")), "file_id")
    ranked = rows.withColumn("path_rank", F.row_number().over(Window.partitionBy("duplicate_group_id").orderBy("s", "file_id"))).where("path_rank <= 5")
    return ranked.select("report_rank", "duplicate_group_id", "reclaimable_bytes", "path_rank", "relative_path")


@query("a32_theoretical_reclaim", "SELECT sum(reclaim)::BIGINT AS reclaim, count(*) AS size_groups FROM cand_sizes", skip_cloud=False)
def a32(spark, sf_dir):
    return hashing.size_groups(entries(spark, sf_dir).drop("text", "walk")).agg(F.sum("reclaim").alias("reclaim"), F.count("*").alias("size_groups"))


@query(
    "a30_report_file_types_w64",
    """SELECT f.extension, count(*) AS files, sum(s.size_bytes)::BIGINT AS bytes, count(s.size_group_id) AS candidates, count(s.duplicate_group_id) AS duplicates
    FROM selective s JOIN files f ON s.file_id = f.file_id GROUP BY f.extension""",
    window=64,
)
def a30(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    f = corpus.files(spark, sf_dir, (1,)).select("file_id", "extension")
    return r.join(f, "file_id").groupBy("extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count("size_group_id").alias("candidates"), F.count("duplicate_group_id").alias("duplicates"))


@query(
    "a31_drift_check",
    """SELECT (SELECT count(*) FROM snap1) AS preliminary_files, (SELECT count(*) FROM snap2) AS run_files, (SELECT count(*) FROM snap2) - (SELECT count(*) FROM snap1) AS file_drift,
      ((SELECT sum(size_bytes) FROM snap2) - (SELECT sum(size_bytes) FROM snap1))::BIGINT AS byte_drift""",
)
def a31(spark, sf_dir):
    total = lambda run, n: history.records(history.snapshot(spark, sf_dir, run)).agg(F.count("*").alias(f"f{n}"), F.sum("size_bytes").alias(f"b{n}"))
    both = total(1, 1).withColumn("k", F.lit(1)).join(total(2, 2).withColumn("k", F.lit(1)), "k")
    return both.select(F.col("f1").alias("preliminary_files"), F.col("f2").alias("run_files"), (F.col("f2") - F.col("f1")).alias("file_drift"), (F.col("b2") - F.col("b1")).alias("byte_drift"))


@query(
    "w12_walk_ordinal",
    "SELECT file_id, row_number() OVER (ORDER BY root_ordinal, walk, file_id) AS db_id FROM files WHERE root_id IN (1, 4)",
)
def w12(spark, sf_dir):
    f = corpus.files(spark, sf_dir, (1, 4)).select("file_id", "root_ordinal", "relative_path").withColumn("walk", paths.walk_key(F.col("relative_path")))
    return numbered(f, "db_id", [F.col("root_ordinal"), F.col("walk"), F.col("file_id")]).select("file_id", "db_id")


@query("j14_latest_measurement", "SELECT file_id, max(run_id) AS run_id, max_by(sha256, run_id) AS sha256 FROM (SELECT file_id, 1 AS run_id, upper(sha256(content)) AS sha256 FROM snap1 WHERE NOT inaccessible UNION ALL SELECT file_id, 3, upper(sha256(content)) FROM snap3 WHERE NOT inaccessible) GROUP BY file_id")
def j14(spark, sf_dir):
    runs = [history.digests(history.snapshot(spark, sf_dir, r)).withColumn("run_id", F.lit(r)) for r in (1, 3)]
    return runs[0].unionByName(runs[1]).groupBy("file_id").agg(F.max("run_id").alias("run_id"), F.max_by("sha256", "run_id").alias("sha256"))


@query("w7_latest_run_per_root", "SELECT root_id, max(run_id) AS run_id FROM observations GROUP BY root_id")
def w7(spark, sf_dir):
    log = history.after(spark, sf_dir, 3)[1]
    return first_of(log.select("root_id", "run_id"), ["root_id"], [F.col("run_id")], last=True).select("root_id", "run_id")
