"""Export relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzers, duplicates, exports, hashing
from ..operators.ranking import numbered
from ..sources import corpus
from .catalog_analyzers import archives
from .catalog_content import entries, hashed_state
from .registry import query


@query(
    "k6_output_map",
    """SELECT *, 'A-canonical' AS classification FROM (VALUES (1, 'preliminary_inventory', 'PreliminaryInventory.csv', 'powershell', 14, 'byte', 'run'), (2, 'potential_duplicates', 'PotentialDuplicates.csv', 'powershell', 6, 'byte', 'duplicate_run'),
      (3, 'partial_hash_candidates', 'PartialHashCandidates.csv', 'powershell', 10, 'byte', 'duplicate_run'), (4, 'full_hash_inventory', 'FullHashInventory.csv', 'powershell', 17, 'byte', 'duplicate_run'),
      (5, 'duplicate_hash_inventory', 'DuplicateHashInventory.csv', 'powershell', 18, 'byte', 'duplicate_run'), (6, 'image', 'ImageHashes.csv', 'python', 10, 'byte', 'analyzer_run'), (7, 'pdf', 'PDFInventory.csv', 'python', 11, 'byte', 'analyzer_run'),
      (8, 'office', 'OfficeInventory.csv', 'python', 11, 'byte', 'analyzer_run'), (9, 'raw_image', 'RawImageInventory.csv', 'python', 11, 'byte', 'analyzer_run'), (10, 'audio', 'AudioInventory.csv', 'python', 15, 'byte', 'analyzer_run'),
      (11, 'video', 'VideoInventory.csv', 'python', 11, 'byte', 'analyzer_run'), (12, 'text', 'TextFileInventory.csv', 'python', 13, 'byte', 'analyzer_run'), (13, 'archive', 'ArchiveInventory.csv', 'python', 8, 'byte', 'analyzer_run'),
      (14, 'archive_contents', 'ArchiveContents.csv', 'python', 5, 'byte', 'analyzer_run'), (15, 'content_index', 'ContentIndex.csv', 'python', 8, 'byte', 'analyzer_run'), (16, 'canonical_inventory', 'Inventory-Canonical.csv', 'python', 32, 'data', 'project'),
      (17, 'current_duplicates', 'Duplicates-Current.csv', 'python', 12, 'data', 'project')) t(ordinal, artifact, file, dialect, columns, equivalence_target, scope)""",
)
def k6(spark, sf_dir):
    return exports.output_map(spark)


@query(
    "k1_csv_powershell",
    """SELECT file_id, '"' || replace(relative_path, '"', '""') || '",' || CASE WHEN size_bytes IS NULL THEN '' ELSE '"' || size_bytes || '"' END || ',"' || extension || '"' AS line FROM files""",
)
def k1(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.select("file_id", F.array_join(F.array(*[exports.cell(F.col(c), "powershell") for c in ("relative_path", "size_bytes", "extension")]), ",").alias("line"))


@query("k1_csv_minimal", """SELECT conv_id, turn, role || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line FROM conversations""")
def k1_minimal(spark, sf_dir):
    c = corpus.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat_ws(",", exports.cell(F.col("role"), "minimal"), exports.cell(F.col("text"), "minimal")).alias("line"))


@query("r6_potential_duplicates", "SELECT s.size_group_id, h.file_id, h.relative_path, h.size_bytes FROM hashable h JOIN cand_sizes s ON h.size_bytes = s.size_bytes", skip_cloud=False)
def r6_potential(spark, sf_dir):
    e = entries(spark, sf_dir).drop("text", "walk")
    return e.join(hashing.size_groups(e).select("size_bytes", "size_group_id"), "size_bytes").select("size_group_id", "file_id", "relative_path", "size_bytes")


@query("r6_partial_hash_candidates_w64", "SELECT h.file_id, h.relative_path, s.size_group_id, s.partial_group_id, s.partial_hash, s.partial_status FROM selective s JOIN hashable h ON s.file_id = h.file_id WHERE s.size_group_id IS NOT NULL", window=64)
def r6_partial(spark, sf_dir):
    e = entries(spark, sf_dir)
    r = hashing.selective(e, 64).where("size_group_id is not null")
    return r.join(e.select("file_id", "relative_path"), "file_id").select("file_id", "relative_path", "size_group_id", "partial_group_id", "partial_hash", "partial_status")


@query("r6_duplicate_hash_inventory", "SELECT h.file_id, h.relative_path, s.final_status, s.duplicate_group_id FROM selective s JOIN hashable h ON s.file_id = h.file_id")
def r6_duplicates(spark, sf_dir):
    e = entries(spark, sf_dir)
    return hashing.selective(e).join(e.select("file_id", "relative_path"), "file_id").select("file_id", "relative_path", "final_status", "duplicate_group_id")


@query(
    "j13_current_duplicates",
    """SELECT d.sha256, d.location_count, d.reclaimable_bytes, p.file_id, p.relative_path, row_number() OVER (PARTITION BY p.sha256 ORDER BY p.root_ordinal, p.path_sort_key, p.file_id) AS member_rank
    FROM dup_sets d JOIN present p ON p.sha256 = d.sha256""",
)
def j13(spark, sf_dir):
    s = hashed_state(spark, sf_dir)
    sets = duplicates.current_sets(s).select("sha256", "location_count", "reclaimable_bytes")
    return duplicates.member_rank(s).join(sets, "sha256").select("sha256", "location_count", "reclaimable_bytes", "file_id", "relative_path", "member_rank")


@query("j3_measured_files_w64", "SELECT h.file_id, h.relative_path, r.root_path, s.final_status, g.members FROM selective s JOIN hashable h ON h.file_id = s.file_id JOIN roots r ON r.root_id = h.root_id LEFT JOIN (SELECT duplicate_group_id, count(*) AS members FROM selective GROUP BY 1) g ON g.duplicate_group_id = s.duplicate_group_id", window=64)
def j3(spark, sf_dir):
    e = entries(spark, sf_dir)
    r = hashing.selective(e, 64)
    groups = hashing.duplicate_groups(r).select("duplicate_group_id", F.col("member_count").alias("members"))
    rows = r.join(e.select("file_id", "root_id", "relative_path"), "file_id").join(corpus.roots(spark), "root_id").join(groups, "duplicate_group_id", "left")
    return rows.select("file_id", "relative_path", "root_path", "final_status", "members")


@query("r6_archive_contents", "SELECT conv_id AS archive_id, role || '/T' || (turn % 3) || '.txt' AS entry_path, length(text)::BIGINT AS size_bytes FROM conversations WHERE (conv_id, lower(role || '/T' || (turn % 3) || '.txt'), turn) IN (SELECT conv_id, lower(role || '/T' || (turn % 3) || '.txt'), min(turn) FROM conversations GROUP BY ALL)")
def r6_archives(spark, sf_dir):
    return analyzers.archive_members(archives(spark, sf_dir)).select("archive_id", "entry_path", "size_bytes")


@query("t4_nulls_last_order", "SELECT file_id, row_number() OVER (ORDER BY duplicate_group_id ASC NULLS LAST, file_id) AS place FROM selective")
def t4(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir)).select("file_id", "duplicate_group_id")
    return numbered(r, "place", [F.asc_nulls_last("duplicate_group_id"), F.col("file_id")]).select("file_id", "place")
