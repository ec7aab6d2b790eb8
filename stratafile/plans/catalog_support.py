"""Queries on the supporting operators: smaller relations that the larger ones build on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, render
from ..operators import analyzers, hashing, ingest
from ..operators.ranking import numbered
from ..sources import corpus
from . import history
from .catalog_analyzers import RESULTS, results
from .catalog_content import entries
from .catalog_inventory import inventory
from .catalog_runs import EVENTS, events
from .registry import query


@query("s4_analyzer_inputs", "SELECT s.file_id, f.file_name, f.extension, s.obs AS current_observation_id FROM state2 s JOIN files f USING (file_id) WHERE s.state = 'present' AND s.run = 2 AND s.obs IS NOT NULL")
def s4(spark, sf_dir):
    now, _ = history.after(spark, sf_dir, 2)
    f = corpus.files(spark, sf_dir, (1, 2)).select("file_id", "file_name", "extension")
    return now.where("state = 'present' and current_run_id = 2 and current_observation_id is not null").join(f, "file_id").select("file_id", "file_name", "extension", "current_observation_id")


@query("j2_state_with_content", "SELECT s.file_id, s.state, c.sha AS sha256, c.locations FROM state2 s LEFT JOIN (SELECT sha, count(*) AS locations FROM state2 WHERE sha IS NOT NULL GROUP BY sha) c ON c.sha = s.sha")
def j2(spark, sf_dir):
    now, _ = history.after(spark, sf_dir, 2)
    content = now.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("locations"))
    return now.select("file_id", "state", "sha256").join(content, "sha256", "left").select("file_id", "state", "sha256", "locations")


@query("j12_rank_by_count", "SELECT a.root_id, (SELECT count(*) FROM roots b WHERE lower(b.root_path) <= lower(a.root_path)) AS ordinal FROM roots a")
def j12(spark, sf_dir):
    return corpus.roots(spark).select("root_id", F.rank().over(Window.orderBy(paths.path_key(F.col("root_path")))).cast("long").alias("ordinal"))


@query("j17_results_of_an_observation", f"SELECT file_id, count(*) AS results, count(*) FILTER (status = 'analyzed') AS analyzed FROM {RESULTS} GROUP BY file_id")
def j17(spark, sf_dir):
    return results(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("results"), F.count_if(F.col("status") == "analyzed").alias("analyzed"))


@query("a7_partial_buckets_w64", "SELECT size_group_id, partial_group_id, count(*) AS members, min(partial_status) AS partial_status FROM selective WHERE partial_group_id IS NOT NULL GROUP BY ALL", window=64)
def a7(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64).where("partial_group_id is not null")
    return r.groupBy("size_group_id", "partial_group_id").agg(F.count("*").alias("members"), F.min("partial_status").alias("partial_status"))


@query(
    "a20_hash_counts_w64",
    "SELECT count(*) AS measurements, count(full_hash) AS full_hashes, count(*) FILTER (partial_hash IS NOT NULL AND full_hash IS NULL) AS partial_only, count(DISTINCT coalesce(full_hash, partial_hash)) AS digests FROM selective",
    window=64,
)
def a20(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64)
    return r.agg(F.count("*").alias("measurements"), F.count("full_hash").alias("full_hashes"), F.count_if(F.col("partial_hash").isNotNull() & F.col("full_hash").isNull()).alias("partial_only"), F.countDistinct(F.coalesce("full_hash", "partial_hash")).alias("digests"))


@query("t5_size_order_with_nulls", "SELECT file_id, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, file_id) AS place FROM files WHERE root_id = 1")
def t5(spark, sf_dir):
    f = corpus.files(spark, sf_dir, (1,)).select("file_id", "size_bytes")
    return numbered(f, "place", [F.desc_nulls_last("size_bytes"), F.col("file_id")]).select("file_id", "place")


@query(
    "f15_counts_and_clocks",
    "SELECT file_id, printf('%02d:%02d:%02d', minutes * 7 // 3600, minutes * 7 % 3600 // 60, minutes * 7 % 60) AS clock, CASE WHEN minutes < 1000 THEN minutes::VARCHAR ELSE (minutes // 1000)::VARCHAR || ',' || lpad((minutes % 1000)::VARCHAR, 3, '0') END AS shown FROM files WHERE root_id = 1",
)
def f15(spark, sf_dir):
    rows = corpus.raw(spark, sf_dir, (1,))
    return rows.select("file_id", render.clock(F.col("minutes") * 7).alias("clock"), F.format_number("minutes", 0).alias("shown"))


@query(
    "f16_estimate_texts",
    """SELECT file_id, CASE WHEN s < 60 THEN 'under a minute' WHEN m < 60 THEN '~' || m || ' min' WHEN m % 60 = 0 THEN '~' || m // 60 || ' hr' ELSE '~' || m // 60 || ' hr ' || m % 60 || ' min' END AS shown
    FROM (SELECT file_id, minutes * 11 AS s, CAST(ceil(minutes * 11 / 60.0) AS BIGINT) AS m FROM files WHERE root_id = 1)""",
)
def f16(spark, sf_dir):
    return corpus.raw(spark, sf_dir, (1,)).select("file_id", render.estimate_text(F.col("minutes") * 11).alias("shown"))


@query("f27_project_folders", "SELECT doc_id, regexp_replace(source || ': ' || lang || '?', '[<>:\"/\\\\|?*]+', '_', 'g') AS folder FROM documents")
def f27(spark, sf_dir):
    d = corpus.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_replace(F.concat("source", F.lit(": "), "lang", F.lit("?")), r'[<>:"/\\|?*]+', "_").alias("folder"))


@query("f31_error_kinds", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FILE MISSING' WHEN 1 THEN 'ACCESS DENIED' WHEN 2 THEN 'NOT A FILE' ELSE 'IO ERROR' END AS error_kind FROM events")
def f31(spark, sf_dir):
    from ..sources.filesystem import KINDS

    e = corpus.read(spark, sf_dir, "events").select("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in ("ENOENT", "EACCES", "EISDIR", "EIO")]), (F.col("event_id") % 4 + 1).cast("int"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return e.select("event_id", F.coalesce(F.try_element_at(kinds, code), F.lit("IO ERROR")).alias("error_kind"))


@query("i3s_path_events", f"SELECT run_id, event_type AS kind, count(*) AS seen FROM {EVENTS} GROUP BY ALL")
def i3s(spark, sf_dir):
    """Appended in two batches that overlap: an event counts once."""
    e = events(spark, sf_dir).select("event_id", "run_id", F.col("event_type").alias("kind"))
    again = ingest.append_new(e.where("event_id % 2 = 0"), e, ["run_id", "kind", "event_id"])
    return again.groupBy("run_id", "kind").agg(F.count("*").alias("seen"))


@query("i8s_reingest", f"SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 2 ELSE 1 END AS version, status FROM {RESULTS}")
def i8s(spark, sf_dir):
    """A second ingest of some keys replaces what the first one left for them."""
    old = results(spark, sf_dir).select("file_id", F.lit(1).alias("version"), "status")
    new = results(spark, sf_dir).where("file_id % 2 = 0").select("file_id", F.lit(2).alias("version"), "status")
    return ingest.replace_keys(old, new, ["file_id"])


@query("x2_root_registration", r"SELECT lower(p) AS root_key, row_number() OVER (ORDER BY lower(p)) + 4 AS root_id FROM (SELECT DISTINCT lower('E:\' || source) AS p FROM documents)")
def x2(spark, sf_dir):
    """Roots that aren't known yet get the next numbers, in key order."""
    asked = corpus.read(spark, sf_dir, "documents").select(paths.path_key(F.concat(F.lit("E:\\"), "source")).alias("root_key")).distinct()
    known = corpus.roots(spark).select(paths.path_key(F.col("root_path")).alias("root_key"))
    fresh = asked.join(known, "root_key", "left_anti")
    return fresh.select("root_key", (F.row_number().over(Window.orderBy("root_key")) + len(corpus.ROOTS)).cast("long").alias("root_id"))


@query("x4_insert_or_ignore", "SELECT user_id AS scan_id, event_id % 50 AS location, min(event_id) AS kept FROM events GROUP BY ALL")
def x4(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("run_id").alias("scan_id"), (F.col("event_id") % 50).alias("location"), "event_id")
    return ingest.insert_or_ignore(e, ["scan_id", "location"], [F.col("event_id")]).select("scan_id", "location", F.col("event_id").alias("kept"))


@query("x7_flags_normalised", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN NULL ELSE true END AS flag FROM events")
def x7(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events").select("event_id")
    raw = F.get(F.array(*[F.lit(x) for x in (None, "1", "0", " True", "NO", "maybe", "yes ")]), (F.col("event_id") % 7).cast("int"))
    return e.select("event_id", ingest.flag_value(raw).alias("flag"))


@query("x9_isolated_failures", "SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'FILE MISSING' ELSE 'NOT A FILE' END AS error_kind, NULL::VARCHAR AS digest FROM documents")
def x9(spark, sf_dir):
    """Every read fails, for real: of a name that isn't there or a folder; each failure is its own row and none stops the others."""
    from ..sources.filesystem import hash_files

    d = corpus.read(spark, sf_dir, "documents").select("doc_id")
    gone = F.col("doc_id") % 3 == 0
    asked = d.select(F.lit("/").alias("root_path"), F.concat(F.when(gone, F.lit("no-such-folder/")).otherwise(F.lit("tmp/../")), F.when(gone, F.col("doc_id").cast("string")).otherwise(F.lit(""))).alias("relative_path"), "doc_id")
    found = hash_files(asked.select("root_path", "relative_path").distinct())
    return asked.join(found, ["root_path", "relative_path"]).select(F.col("doc_id").alias("file_id"), "error_kind", "digest")


@query("x10_one_run_per_mode", "SELECT root_id, mode, max(run_id) AS run_id FROM (SELECT user_id % 4 AS root_id, CASE WHEN event_id % 2 = 0 THEN 'selective' ELSE 'exhaustive' END AS mode, user_id AS run_id FROM events) GROUP BY ALL")
def x10(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("run_id") % 4).alias("root_id"), F.when(F.col("event_id") % 2 == 0, "selective").otherwise("exhaustive").alias("mode"), "run_id")
    return ingest.open_run(e, ["root_id", "mode"], F.col("run_id")).select("root_id", "mode", "run_id")


@query("x11_measurements_with_content_w64", "SELECT s.file_id, coalesce(s.full_hash, CASE WHEN s.size_bytes <= 64 THEN s.partial_hash END) AS sha256, s.final_status FROM selective s WHERE s.size_group_id IS NOT NULL", window=64)
def x11(spark, sf_dir):
    r = hashing.selective(entries(spark, sf_dir), 64).where("size_group_id is not null")
    sha, _ = hashing.identity(F.col("full_hash"), F.col("partial_hash"), F.col("size_bytes"), 64)
    return r.select("file_id", sha.alias("sha256"), "final_status")


@query("x15_child_parents", "SELECT c.conv_id AS archive_id, c.turn, p.first_role FROM conversations c JOIN (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1) p ON p.conv_id = c.conv_id")
def x15(spark, sf_dir):
    c = corpus.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("archive_id"), "turn", "role")
    return ingest.with_parents(c, c.groupBy("archive_id").agg(F.min_by("role", "turn").alias("first_role")), "archive_id", ["first_role"]).select("archive_id", "turn", "first_role")


@query("x18_full_paths", r"SELECT f.file_id, r.root_path || '\' || f.relative_path AS full_path FROM files f JOIN roots r USING (root_id)")
def x18(spark, sf_dir):
    return inventory(spark, sf_dir).select("file_id", "full_path")


@query("x23_report_metadata", "SELECT s.file_id, f.relative_path, f.extension, f.attributes, s.final_status FROM selective s JOIN files f ON f.file_id = s.file_id")
def x23(spark, sf_dir):
    f = corpus.files(spark, sf_dir, (1,)).select("file_id", "relative_path", "extension", "attributes")
    return hashing.selective(entries(spark, sf_dir)).select("file_id", "final_status").join(f, "file_id").select("file_id", "relative_path", "extension", "attributes", "final_status")


@query("x27_ingest_stage_rows", f"SELECT run_id, 'inventory_ingest' AS stage_key, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM {EVENTS} GROUP BY run_id")
def x27(spark, sf_dir):
    """Errors of the ingest never fail the run: they make warnings."""
    e = events(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("severity") == "error").alias("bad"))
    return e.select("run_id", F.lit("inventory_ingest").alias("stage_key"), ingest.stage_outcome(F.col("bad"), fatal=False).alias("status"))


@query("n8_analyzer_report", r"SELECT ext AS suffix, sum(n)::BIGINT AS chars, count(*) AS files FROM (SELECT lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS ext, length(content) AS n FROM files WHERE NOT inaccessible AND root_id IN (1, 2)) WHERE ext IN ('.txt', '.md') GROUP BY ext")
def n8_report(spark, sf_dir):
    rows = corpus.raw(spark, sf_dir, (1, 2)).where(~F.col("inaccessible")).withColumn("file_name", F.substring_index("relative_path", "\\", -1))
    t = analyzers.applicable(rows, analyzers.by_key("text"))
    return t.groupBy(paths.suffix(F.col("file_name")).alias("suffix")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("files"))
