"""Queries on inventory statistics, names, exports and estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import attrs, paths, render
from ..operators import stats
from ..operators.ranking import first_of, numbered
from ..sources import corpus
from .registry import query


def inventory(spark, sf_dir, only=(1, 2, 3, 4)):
    """Files with full path, path length and presentation order."""
    f = stats.with_full_path(corpus.files(spark, sf_dir, only), corpus.roots(spark))
    return f.withColumn("ord", F.struct("root_ordinal", "path_sort_key", "file_id"))


FULL = r"(SELECT f.*, r.root_path || '\' || f.relative_path AS full_path, length(r.root_path || '\' || f.relative_path) AS path_length FROM files f JOIN roots r ON f.root_id = r.root_id)"


@query("s1_inventory_scan", f"SELECT root_id, file_id, full_path, file_name, extension, size_bytes, depth, path_length, attributes, status FROM {FULL}")
def s1(spark, sf_dir):
    return inventory(spark, sf_dir).select("root_id", "file_id", "full_path", "file_name", "extension", "size_bytes", "depth", "path_length", "attributes", "status")


@query(
    "a13_scan_totals",
    f"""SELECT root_id, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes, count(*) FILTER (coalesce(size_bytes, 0) = 0) AS empty_files, count(*) FILTER (path_length > 260) AS long_paths,
      count(*) FILTER (contains(attributes, 'Hidden')) AS hidden, count(*) FILTER (contains(attributes, 'System')) AS system, count(*) FILTER (cloud) AS offline, max(depth) AS max_depth FROM {FULL} GROUP BY root_id""",
)
def a13(spark, sf_dir):
    f = inventory(spark, sf_dir)
    out = None
    for root, _ in corpus.ROOTS:
        one = stats.totals(f.where(F.col("root_id") == root)).drop("median_size", "mean_size").withColumn("root_id", F.lit(root))
        out = one if out is None else out.unionByName(one)
    return out


@query("a16_size_stats", "SELECT median(coalesce(size_bytes, 0)) AS median_size, round(avg(coalesce(size_bytes, 0)), 6) AS mean_size FROM files")
def a16(spark, sf_dir):
    return stats.totals(inventory(spark, sf_dir)).select("median_size", F.round("mean_size", 6).alias("mean_size"))


@query("a14_by_extension", "SELECT lower(extension) AS key, arg_min(extension, {'a': root_ordinal, 'b': path_sort_key, 'c': file_id}) AS extension, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM files GROUP BY lower(extension)")
def a14(spark, sf_dir):
    return stats.by_folded(inventory(spark, sf_dir), "extension").drop("first")


@query(
    "a14_by_top_level",
    r"SELECT root_id, CASE WHEN depth = 0 THEN '(root)' ELSE string_split(relative_path, '\')[1] END AS folder, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM files GROUP BY ALL",
)
def a14_top(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.groupBy("root_id", paths.top_level(F.col("relative_path")).alias("folder")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


@query("a15_depth_histogram", "SELECT depth, count(*) AS files FROM files GROUP BY depth")
def a15(spark, sf_dir):
    return corpus.files(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("files"))


@query("a17_name_collisions", "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files FROM (SELECT count(*) AS n FROM files GROUP BY lower(file_name) HAVING count(*) > 1)")
def a17(spark, sf_dir):
    return stats.name_collisions(corpus.files(spark, sf_dir))


@query(
    "a18_oldest_newest",
    f"""SELECT o.at AS oldest_at, o.path AS oldest_path, n.at AS newest_at, n.path AS newest_path FROM (
      SELECT min({{'at': 1704067200 + minutes * 60, 'f': lower(full_path), 'path': full_path}}) AS o, max({{'at': 1704067200 + minutes * 60, 'f': lower(full_path), 'path': full_path}}) AS n FROM {FULL})""",
)
def a18(spark, sf_dir):
    return stats.oldest_and_newest(inventory(spark, sf_dir))


@query("t1_largest_files", f"SELECT full_path, coalesce(size_bytes, 0) AS size_bytes FROM {FULL} ORDER BY coalesce(size_bytes, 0) DESC, lower(full_path), full_path LIMIT 20")
def t1(spark, sf_dir):
    return stats.largest(inventory(spark, sf_dir)).select("full_path", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"))


@query(
    "t2_top_folders",
    r"""SELECT folder, bytes FROM (SELECT CASE WHEN depth = 0 THEN '(root)' ELSE string_split(relative_path, '\')[1] END AS folder, sum(coalesce(size_bytes, 0))::BIGINT AS bytes, min({'a': path_sort_key, 'b': file_id}) AS f
      FROM files WHERE root_id = 1 GROUP BY 1) ORDER BY bytes DESC, f LIMIT 20""",
)
def t2(spark, sf_dir):
    f = inventory(spark, sf_dir, (1,)).withColumn("folder", paths.top_level(F.col("relative_path")))
    return f.groupBy("folder").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"), F.min("ord").alias("first")).orderBy(F.desc("bytes"), "first").limit(20).select("folder", "bytes")


@query(
    "t3_calibration_sample",
    """SELECT file_id, size_bytes FROM (SELECT *, sum(size_bytes) OVER (ORDER BY k) AS running FROM (
      SELECT file_id, size_bytes, row_number() OVER (ORDER BY root_ordinal, path_sort_key, file_id) AS k FROM files WHERE NOT inaccessible AND NOT cloud AND size_bytes > 0 ORDER BY k LIMIT 200)) WHERE k <= 15 AND running <= 52428800""",
)
def t3(spark, sf_dir):
    f = inventory(spark, sf_dir).where("status = 'observed' and not is_offline_or_cloud and size_bytes > 0").orderBy("ord").limit(200)
    w = Window.orderBy("ord")
    return f.select("file_id", "size_bytes", F.row_number().over(w).alias("k"), F.sum("size_bytes").over(w).alias("running")).where("k <= 15 and running <= 52428800").select("file_id", "size_bytes")


@query(
    "t7_inaccessible_cap",
    "SELECT file_id, relative_path, (SELECT count(*) FROM files WHERE inaccessible) AS seen, (SELECT count(*) FROM files WHERE inaccessible) > 5 AS truncated FROM files WHERE inaccessible ORDER BY root_ordinal, path_sort_key, file_id LIMIT 5",
)
def t7(spark, sf_dir):
    bad = inventory(spark, sf_dir).where("status = 'inaccessible'")
    total = bad.agg(F.count("*").alias("seen")).withColumn("truncated", F.col("seen") > 5)
    return bad.orderBy("ord").limit(5).select("file_id", "relative_path", F.lit(1).alias("k")).join(total.withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "a23_estimate_inputs",
    """SELECT sum(n)::BIGINT AS total_files, sum(size_bytes * n)::BIGINT AS total_bytes, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS candidate_files, coalesce(sum(size_bytes * n) FILTER (n > 1), 0)::BIGINT AS candidate_bytes
    FROM (SELECT size_bytes, count(*) AS n FROM files WHERE NOT inaccessible GROUP BY size_bytes)""",
)
def a23(spark, sf_dir):
    return stats.estimate(corpus.files(spark, sf_dir).where("status = 'observed'")).drop("full_seconds", "selective_seconds")


@query(
    "f29_run_estimates",
    """SELECT round(greatest(tb / 3145728.0, tf * 0.0004) + tf * 0.0001, 6) AS full_seconds, round(greatest(cb / 3145728.0, cf * 0.0004) + cf * 0.0001, 6) AS selective_seconds FROM (
      SELECT sum(n) AS tf, sum(size_bytes * n)::DOUBLE AS tb, sum(n) FILTER (n > 1) AS cf, (sum(size_bytes * n) FILTER (n > 1))::DOUBLE AS cb FROM (SELECT size_bytes, count(*) AS n FROM files WHERE NOT inaccessible GROUP BY size_bytes))""",
)
def f29(spark, sf_dir):
    e = stats.estimate(corpus.files(spark, sf_dir).where("status = 'observed'"))
    return e.select(F.round("full_seconds", 6).alias("full_seconds"), F.round("selective_seconds", 6).alias("selective_seconds"))


@query("f2_eligible_suffixes", r"SELECT file_name, lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS suffix, extension FROM files")
def f2(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_name", paths.suffix(F.col("file_name")).alias("suffix"), "extension")


@query("f3_path_keys", r"SELECT file_id, lower(relative_path) AS path_key, replace(path_sort_key, chr(0), '|') AS sort_key, depth, length(relative_path) AS utf16 FROM files")
def f3(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.select("file_id", paths.path_key(F.col("relative_path")).alias("path_key"), F.replace("path_sort_key", F.lit("\x00"), F.lit("|")).alias("sort_key"), "depth", paths.utf16_length(F.col("relative_path")).alias("utf16"))


@query(
    "f5_path_parts",
    r"""SELECT file_id, CASE WHEN depth = 0 THEN '(root)' ELSE string_split(relative_path, '\')[1] END AS top_level,
      CASE WHEN depth = 0 THEN '' ELSE array_to_string(string_split(relative_path, '\')[1:depth], '\') END AS parent FROM files""",
)
def f5(spark, sf_dir):
    r = F.col("relative_path")
    return corpus.files(spark, sf_dir).select("file_id", paths.top_level(r).alias("top_level"), paths.parent(r).alias("parent"))


@query("f7_attribute_names", "SELECT attribute_word, attributes, cloud AS is_cloud, (attribute_word & 34) = 34 AS hidden_archive, count(*) AS files FROM files GROUP BY ALL")
def f7(spark, sf_dir):
    w = F.col("attribute_word")
    return corpus.files(spark, sf_dir).groupBy("attribute_word", "attributes", attrs.is_cloud(w).alias("is_cloud"), attrs.has_all(w, 34).alias("hidden_archive")).agg(F.count("*").alias("files"))


@query("f9_iso_times", "SELECT file_id, strftime(make_timestamp((1704067200 + minutes * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM files")
def f9(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    ns = F.unix_seconds("modified_utc") * F.lit(1_000_000_000).cast("long") + F.lit(999)
    return f.select("file_id", render.iso_from_ns(ns).alias("modified"))


@query(
    "f11_canonical_time",
    "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN file_id % 3 = 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || ' (local)' ELSE '' END AS cell FROM (SELECT file_id, make_timestamp((1704067200 + minutes * 60) * 1000000) AS t FROM files)",
)
def f11(spark, sf_dir):
    k, t = F.col("file_id") % 3, F.col("modified_utc")
    return corpus.files(spark, sf_dir).select("file_id", render.canonical_time(F.when(k == 0, t), F.when(k == 1, t)).alias("cell"))


@query(
    "f12_locale_time",
    "SELECT file_id, strftime(t, '%-m/%-d/%Y %-I:%M:%S %p') AS mdy, strftime(t, '%-d/%-m/%Y %-I:%M:%S %p') AS dmy FROM (SELECT file_id, make_timestamp((1704067200 + minutes * 60) * 1000000) AS t FROM files)",
)
def f12(spark, sf_dir):
    t = F.col("modified_utc")
    return corpus.files(spark, sf_dir).select("file_id", render.locale_time(t, "MDY").alias("mdy"), render.locale_time(t, "DMY").alias("dmy"))


@query("f13_flags_and_durations", "SELECT file_id, CASE WHEN cloud THEN 'True' ELSE 'False' END AS offline, printf('%.6f', coalesce(size_bytes, 0) / 3.0) AS duration FROM files")
def f13(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.select("file_id", render.flag(F.col("is_offline_or_cloud")).alias("offline"), render.duration(F.coalesce("size_bytes", F.lit(0)) / F.lit(3.0)).alias("duration"))


SHOWN = "CASE " + " ".join(f"WHEN b < {1024 ** (k + 1)} THEN (b / {1024**k}.0::DOUBLE)" for k in range(4)) + f" ELSE b / {1024**4}.0::DOUBLE END"


@query(
    "f14_human_bytes",
    f"""SELECT b AS size_bytes, format('{{:,}}', floor(v)::BIGINT) || printf('.%02d', (v * 100 - floor(v) * 100)::BIGINT) || ' ' || CASE WHEN b < 1024 THEN 'B' WHEN b < 1048576 THEN 'KB' WHEN b < 1073741824 THEN 'MB' WHEN b < 1099511627776 THEN 'GB' ELSE 'TB' END AS shown
    FROM (SELECT b, round(({SHOWN})::DECIMAL(30, 10), 2) AS v FROM (SELECT DISTINCT size_bytes * m AS b FROM files, (VALUES (1), (4099), (2097169), (8589934609), (3298534883327)) t(m) WHERE size_bytes IS NOT NULL))""",
)
def f14(spark, sf_dir):
    """All sizes, and multiples of them up to terabytes."""
    sizes = corpus.files(spark, sf_dir).where("size_bytes is not null").select("size_bytes").distinct()
    sizes = sizes.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in (1, 4099, 2097169, 8589934609, 3298534883327)]))).select((F.col("size_bytes") * F.col("m")).alias("size_bytes")).distinct()
    return sizes.select("size_bytes", render.human_bytes(F.col("size_bytes")).alias("shown"))


@query("f26_shard_paths", "SELECT file_id, sha[1:2] || '/' || sha[3:4] || '/' || sha || '.txt' AS shard FROM (SELECT file_id, sha256(content) AS sha FROM files WHERE NOT inaccessible AND root_id = 4)")
def f26(spark, sf_dir):
    rows = corpus.raw(spark, sf_dir, (4,))
    return rows.select("file_id", paths.shard_path(F.sha2(F.encode("text", "UTF-8"), 256)).alias("shard"))


@query(
    "j10_root_resolution",
    r"""WITH asked AS (SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'c:\data\x' || doc_id WHEN 1 THEN 'C:\DATA\Photos\y' || doc_id WHEN 2 THEN 'C:\DataX\z' || doc_id ELSE 'C:\Data' END AS path FROM documents),
    known AS (SELECT * FROM (VALUES (1, 'C:\Data'), (2, 'C:\Data\Photos'), (3, 'D:\Web')) t(root_id, root_path))
    SELECT file_id, coalesce(best, 1) AS root_id, best IS NULL AS unmatched FROM (
      SELECT a.file_id, (SELECT arg_max(k.root_id, length(k.root_path)) FROM known k WHERE lower(a.path) = lower(k.root_path) OR starts_with(lower(a.path), lower(k.root_path) || '\')) AS best FROM asked a)""",
)
def j10(spark, sf_dir):
    """Longest root that is a prefix up to a separator. Each path asks for its own few parent folders by equality: no theta join."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, F.concat(F.lit("c:\\data\\x"), k)).when(k % 4 == 1, F.concat(F.lit("C:\\DATA\\Photos\\y"), k)).when(k % 4 == 2, F.concat(F.lit("C:\\DataX\\z"), k)).otherwise("C:\\Data")
    asked = corpus.read(spark, sf_dir, "documents").select(k.alias("file_id"), kind.alias("path"))
    known = spark.createDataFrame([(1, r"C:\Data"), (2, r"C:\Data\Photos"), (3, r"D:\Web")], "root_id int, root_path string")
    p = paths.parts(paths.path_key(F.col("path")))
    up = asked.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "\\"))).alias("key"))
    hits = up.join(known.select("root_id", paths.path_key(F.col("root_path")).alias("key")), "key")
    best = hits.groupBy("file_id").agg(F.max_by("root_id", F.length("key")).alias("best"))
    return asked.select("file_id").join(best, "file_id", "left").select("file_id", F.coalesce("best", F.lit(1)).alias("root_id"), F.col("best").isNull().alias("unmatched"))


@query("w6_root_ordinals", "SELECT root_id, row_number() OVER (ORDER BY lower(root_path), root_id) AS root_ordinal FROM roots")
def w6(spark, sf_dir):
    return corpus.roots(spark).select("root_id", F.row_number().over(Window.orderBy(paths.path_key(F.col("root_path")), "root_id")).alias("root_ordinal"))


@query("u6_equivalent_roots", r"SELECT lower(rtrim(p, '\/')) AS root_key, count(*) AS spellings FROM (VALUES ('C:\Data'), ('c:\data\'), ('C:\DATA/'), ('D:\Web')) t(p) GROUP BY 1 HAVING count(*) > 1")
def u6(spark, sf_dir):
    rows = spark.createDataFrame([("C:\\Data",), ("c:\\data\\",), ("C:\\DATA/",), ("D:\\Web",)], "p string")
    return rows.groupBy(paths.path_key(F.col("p")).alias("root_key")).agg(F.count("*").alias("spellings")).where("spellings > 1")




@query(
    "p1_canonical_inventory",
    r"""SELECT f.file_id, r.root_path || '\' || f.relative_path AS full_path, f.file_name, f.extension, f.size_bytes, f.attributes, s.state, s.sha AS sha256,
      CASE WHEN s.sha IS NOT NULL THEN CASE WHEN s.content_obs = s.obs THEN 'True' ELSE 'False' END END AS content_is_current, f.root_ordinal
    FROM state2 s JOIN files f USING (file_id) JOIN roots r ON r.root_id = f.root_id""",
)
def p1(spark, sf_dir):
    from . import history

    now, _ = history.after(spark, sf_dir, 2)
    f = inventory(spark, sf_dir, (1, 2)).select("file_id", "full_path", "file_name", "extension", "size_bytes", "attributes", "root_ordinal")
    rows = now.select("file_id", "state", "sha256", "content_observation_id", "current_observation_id").join(f, "file_id")
    current = F.when(F.col("sha256").isNotNull(), render.flag(F.coalesce(F.col("content_observation_id") == F.col("current_observation_id"), F.lit(False))))
    return rows.select("file_id", "full_path", "file_name", "extension", "size_bytes", "attributes", "state", "sha256", current.alias("content_is_current"), "root_ordinal")


@query(
    "p2_legacy_inventory",
    f"SELECT row_number() OVER (ORDER BY root_ordinal, path_sort_key, file_id) AS row_no, full_path, file_name, extension, coalesce(size_bytes, 0) AS size, attributes FROM {FULL} WHERE NOT inaccessible AND root_id = 3",
)
def p2(spark, sf_dir):
    f = inventory(spark, sf_dir, (3,)).where("status = 'observed'")
    rows = numbered(f, "row_no", [F.col("ord")])
    return rows.select("row_no", "full_path", "file_name", "extension", F.coalesce("size_bytes", F.lit(0)).alias("size"), "attributes")


@query("p3_record_mapping", "SELECT file_id, root_id, lower(relative_path) AS relative_path_key, status, size_bytes IS NULL AS size_unknown, CASE WHEN file_index IS NULL THEN 'unknown' ELSE 'known' END AS identity_state FROM files")
def p3(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_id", "root_id", paths.path_key(F.col("relative_path")).alias("relative_path_key"), "status", F.col("size_bytes").isNull().alias("size_unknown"), F.when(F.col("file_index").isNull(), "unknown").otherwise("known").alias("identity_state"))


@query("p11_status_split", "SELECT root_id, status, count(*) AS files FROM files GROUP BY ALL")
def p11(spark, sf_dir):
    return corpus.files(spark, sf_dir).groupBy("root_id", "status").agg(F.count("*").alias("files"))


@query("j1_star_join", r"SELECT f.file_id, r.root_ordinal, r.root_path || '\' || f.relative_path AS full_path FROM files f JOIN roots r ON f.root_id = r.root_id")
def j1(spark, sf_dir):
    return inventory(spark, sf_dir).select("file_id", "root_ordinal", "full_path")


@query("j11_newest_per_folder", r"SELECT folder, arg_max(file_id, {'m': minutes, 'f': file_id}) AS newest_file FROM (SELECT *, CASE WHEN depth = 0 THEN '(root)' ELSE string_split(relative_path, '\')[1] END AS folder FROM files) GROUP BY folder")
def j11(spark, sf_dir):
    f = corpus.files(spark, sf_dir).withColumn("folder", paths.top_level(F.col("relative_path")))
    return first_of(f.select("folder", "file_id", "modified_utc"), ["folder"], [F.col("modified_utc"), F.col("file_id")], last=True).select("folder", F.col("file_id").alias("newest_file"))


@query("s18_bulk_lookup", "SELECT a.doc_id, f.file_id, f.size_bytes FROM (SELECT doc_id, source || '\\' || lang || '\\' || name AS p FROM named) a JOIN files f ON f.root_id = 1 AND f.relative_path = a.p".replace("\\\\", "\\"))
def s18(spark, sf_dir):
    d = corpus.read(spark, sf_dir, "documents")
    wanted = d.select("doc_id", F.concat_ws("\\", "source", "lang", corpus.document_name(F.col("doc_id"))).alias("relative_path"))
    return wanted.join(corpus.files(spark, sf_dir, (1,)), "relative_path").select("doc_id", "file_id", "size_bytes")


@query(
    "s19_manifest_check",
    """SELECT file_id, CASE WHEN f IS NULL THEN 'MISSING' WHEN w IS NULL THEN 'UNLISTED' WHEN w <> f THEN 'MISMATCH' ELSE 'OK' END AS verdict FROM (
      SELECT coalesce(e.file_id, a.file_id) AS file_id, e.sha AS w, a.sha AS f FROM (SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'wrong' ELSE upper(sha256(content)) END AS sha FROM files WHERE root_id = 4 AND file_id % 5 <> 0) e
      FULL OUTER JOIN (SELECT file_id, upper(sha256(content)) AS sha FROM files WHERE root_id = 4 AND file_id % 3 <> 0) a ON e.file_id = a.file_id)""",
)
def s19(spark, sf_dir):
    from ..operators.hashing import digest

    rows = corpus.raw(spark, sf_dir, (4,)).select("file_id", digest(F.col("text")).alias("sha"))
    expected = rows.where("file_id % 5 <> 0").select("file_id", F.when(F.col("file_id") % 7 == 0, "wrong").otherwise(F.col("sha")).alias("w"))
    actual = rows.where("file_id % 3 <> 0").select("file_id", F.col("sha").alias("f"))
    verdict = F.when(F.col("f").isNull(), "MISSING").when(F.col("w").isNull(), "UNLISTED").when(F.col("w") != F.col("f"), "MISMATCH").otherwise("OK")
    return expected.join(actual, "file_id", "full_outer").select("file_id", verdict.alias("verdict"))
