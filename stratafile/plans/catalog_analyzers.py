"""Queries on analyzers. Results come from ``labels``: a document without a label wasn't processed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analyzers
from ..sources import corpus
from .registry import query

WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TEXTS = r"(SELECT file_id, content AS text, relative_path, root_ordinal, path_sort_key FROM files WHERE NOT inaccessible AND root_id IN (1, 2) AND lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) IN ('.txt', '.md'))"


def texts(spark, sf_dir, only=(1, 2)):
    rows = corpus.raw(spark, sf_dir, only).where(~F.col("inaccessible"))
    name = F.substring_index("relative_path", "\\", -1)
    ordinal = F.when(F.col("root_id") == 1, 1).otherwise(2)
    return analyzers.applicable(rows.withColumn("file_name", name).withColumn("root_ordinal", ordinal), analyzers.by_key("text"))


LINES = r"len(regexp_extract_all(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]')) + CASE WHEN text <> '' AND NOT regexp_matches(text, '[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]$') THEN 1 ELSE 0 END"


BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
SPLIT = rf"regexp_split_to_array(text, '\r\n|{BREAKS}')"
HEAD_LINE = r"regexp_matches(x, '^[\t\x1f\p{Zs}]*#{1,6}[\t\x1f\p{Zs}]')"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
TRIM = lambda t: f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"
FRONT = "CASE WHEN starts_with(text, '---') AND contains(substr(text, 4), chr(10) || '---') THEN string_split(substr(text, 4), chr(10) || '---')[1] ELSE '' END"
TITLE = "coalesce(nullif(trim(trim(" + TRIM(f"regexp_extract({FRONT}, '(?m)^title:{SPACE}*(.+)$', 1)") + """, '"'), ''''), ''), nullif(""" + TRIM(f"regexp_extract(text, '(?m)^#{SPACE}+(.+)$', 1)") + ", ''))"
MARKDOWN = f"""{TITLE} AS title, len(list_filter({SPLIT}, lambda x: {HEAD_LINE}))::INT AS headings, len(regexp_extract_all(text, '\\[\\[.*?\\]\\]'))::INT AS wiki_links,
      coalesce(list_sum(list_transform(list_filter({SPLIT}, lambda x: NOT {HEAD_LINE}), lambda x: len(regexp_extract_all(x, '#[A-Za-z]')))), 0)::INT AS tags, starts_with(text, '---') AS front_matter"""


@query(
    "n8_text_stats",
    f"""SELECT file_id, len(regexp_extract_all(text, '[^{WS}]+'))::INT AS word_count, length(text)::INT AS char_count, ({LINES})::INT AS line_count, {MARKDOWN} FROM {TEXTS}""",
)
def n8(spark, sf_dir):
    return analyzers.text_stats(texts(spark, sf_dir)).select("file_id", "word_count", "char_count", "line_count", "title", "headings", "wiki_links", "tags", "front_matter")


@query("f17_word_counts", f"SELECT file_id, len(regexp_extract_all(content, '[^{WS}]+'))::INT AS words FROM files WHERE NOT inaccessible")
def f17(spark, sf_dir):
    return corpus.raw(spark, sf_dir).where(~F.col("inaccessible")).select("file_id", text.word_count(F.col("text")).alias("words"))


@query("f18_line_counts", f"SELECT file_id, ({LINES.replace('text', 'content')})::INT AS lines FROM files WHERE NOT inaccessible")
def f18(spark, sf_dir):
    return corpus.raw(spark, sf_dir).where(~F.col("inaccessible")).select("file_id", text.line_count(F.col("text")).alias("lines"))



@query(
    "f21_markdown",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x y' ELSE 'Title ' || doc_id END AS title, 2 AS headings, 1 AS wiki_links, 2 AS tags, doc_id % 2 = 0 AS front_matter FROM documents",
)
def f21(spark, sf_dir):
    """Made-up bodies with everything in them; ``n8_text_stats`` reads the texts themselves."""
    k = F.col("doc_id")
    body = F.concat(F.lit("# Title "), k, F.lit("\nsee [[Page "), k % 5, F.lit("]] and #tag"), k % 3, F.lit(" #tag"), k % 3, F.lit("\n  ## Part\n####### none\n"), F.col("lang"))
    rows = corpus.read(spark, sf_dir, "documents").select(k, F.when(k % 2 == 0, F.concat(F.lit("---\ntitle:  'x y' \n---\n"), body)).otherwise(body).alias("text"))
    return analyzers.text_stats(rows).select("doc_id", "title", "headings", "wiki_links", "tags", "front_matter")


@query(
    "n10_extraction_index",
    f"""SELECT file_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS text_sha256, CASE WHEN length(text) = 0 THEN 'empty' ELSE 'extracted' END AS status,
      length(text) > 0 AND row_number() OVER (PARTITION BY text ORDER BY root_ordinal, path_sort_key, file_id) > 1 AS reused FROM {TEXTS}""",
)
def n10(spark, sf_dir):
    order = [F.col("root_ordinal"), paths.sort_key(F.col("relative_path")), F.col("file_id")]
    return analyzers.extraction(texts(spark, sf_dir), order).select("file_id", "text_sha256", "status", "reused")


@query(
    "n11_registry",
    """SELECT * FROM (VALUES ('image', 1, 14, 21, 'width_px,height_px', 'pHash,aHash,dHash,Format,HashSize'), ('pdf', 2, 1, 0, 'title,author,content_created_reported', 'PageCount,IsEncrypted,HasExtractableText,Producer'),
      ('office', 3, 6, 0, 'title,author,content_created_reported', 'OfficeType,ExtractionMode,Modified,ContentCount'), ('raw_image', 4, 21, 0, 'content_created_reported', 'CameraMake,CameraModel,ExposureTime,FNumber,ISO,FocalLength'),
      ('audio', 5, 9, 0, 'duration_seconds,title', 'Bitrate,Codec,SampleRate,Channels,Artist,Album,Year,TrackNumber,Genre'), ('video', 6, 11, 0, 'duration_seconds,width_px,height_px', 'Bitrate,VideoCodec,FrameRate,AudioCodec'),
      ('text', 7, 2, 0, 'title,word_count,char_count', 'LineCount,Encoding,HasFrontmatter,HeadingCount,WikilinkCount,TagCount'), ('archive', 8, 2, 0, '', 'EntryCount,TotalUncompressedSize,TotalCompressedSize,CompressionRatioPercent'),
      ('content_extraction', 9, 6, 0, 'word_count,char_count', 'SourceType,ExtractedTextFile')) t(analyzer_key, ordinal, suffixes, excluded, promoted, detail)""",
)
def n11(spark, sf_dir):
    r = analyzers.registry(spark)
    return r.select("analyzer_key", "ordinal", F.size("suffixes").alias("suffixes"), F.size("excluded").alias("excluded"), F.array_join("promoted", ",").alias("promoted"), F.array_join("detail", ",").alias("detail"))


@query(
    "n11_registry_suffixes",
    """SELECT analyzer_key, unnest(string_split(list, ' ')) AS suffix FROM (VALUES ('image', '.jpg .jpeg .jfif .png .gif .bmp .tiff .tif .webp .ico .heic .heif .avif .jp2'), ('pdf', '.pdf'), ('office', '.docx .xlsx .pptx .doc .xls .ppt'),
      ('raw_image', '.3fr .arw .cr2 .cr3 .dng .erf .iiq .kdc .mrw .nef .nrw .orf .pef .raf .raw .rw2 .rwl .sr2 .srf .srw .x3f'), ('audio', '.mp3 .wav .flac .m4a .aac .ogg .wma .opus .aiff'),
      ('video', '.mp4 .mkv .avi .mov .wmv .flv .webm .m4v .mpg .mpeg .3gp'), ('text', '.txt .md'), ('archive', '.zip .7z'), ('content_extraction', '.pdf .docx .pptx .xlsx .txt .md')) t(analyzer_key, list)""",
)
def n11_suffixes(spark, sf_dir):
    return analyzers.registry(spark).select("analyzer_key", F.explode("suffixes").alias("suffix"))


@query("u7_registry_equality", "SELECT 0::BIGINT AS differences")
def u7(spark, sf_dir):
    a = analyzers.registry(spark).select("analyzer_key")
    differences = None
    for keys in (analyzers.SPEC_KEYS, tuple(analyzers.EXPORTS), analyzers.STORED_KEYS):
        b = spark.createDataFrame([(k,) for k in keys], "analyzer_key string")
        either = a.exceptAll(b).unionAll(b.exceptAll(a))
        differences = either if differences is None else differences.unionAll(either)
    return differences.agg(F.count("*").alias("differences"))


@query(
    "p7_applicable_files",
    r"SELECT lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS suffix, count(*) FILTER (NOT cloud) AS applicable, count(*) FILTER (cloud) AS excluded FROM files WHERE NOT inaccessible AND lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) IN ('.txt', '.md') GROUP BY 1",
)
def p7(spark, sf_dir):
    f = analyzers.applicable(corpus.files(spark, sf_dir).where("status = 'observed'"), analyzers.by_key("text"))
    out = F.col("is_offline_or_cloud")
    return f.groupBy(paths.suffix(F.col("file_name")).alias("suffix")).agg(F.count_if(~out).alias("applicable"), F.count_if(out).alias("excluded"))


MADE_NAMES = ".jpg .NEF .pdf .docx .raw .wav .3gp .md .zip .txt .ts".split()


@query(
    "p7_selection_with_exclusions",
    """SELECT k AS analyzer_key, count(*) FILTER (NOT raw) AS applicable, count(*) FILTER (raw) AS excluded FROM (
      SELECT k, s IN ('.nef', '.raw') AND k = 'image' AS raw FROM (SELECT ['.jpg', '.nef', '.pdf', '.docx', '.raw', '.wav', '.3gp', '.md', '.zip', '.txt', '.ts'][doc_id % 11 + 1] AS s FROM documents) d
      JOIN (VALUES ('image', '.jpg'), ('image', '.nef'), ('image', '.raw'), ('pdf', '.pdf'), ('office', '.docx'), ('raw_image', '.nef'), ('raw_image', '.raw'), ('audio', '.wav'), ('video', '.3gp'), ('text', '.md'), ('text', '.txt'),
        ('archive', '.zip'), ('content_extraction', '.pdf'), ('content_extraction', '.docx'), ('content_extraction', '.md'), ('content_extraction', '.txt')) t(k, want) ON want = s) GROUP BY k""",
)
def p7_selection(spark, sf_dir):
    """Documents under made-up names of eleven kinds; image analysis counts camera files and leaves them to its neighbour."""
    d = corpus.read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), corpus.pick(F.col("doc_id"), tuple(MADE_NAMES))).alias("file_name"))
    return analyzers.selection(d, spark)


RESULTS = """(SELECT d.doc_id AS file_id, CASE WHEN l.doc_id IS NULL THEN 'not_processed' WHEN l.toxic = 1 THEN 'error' WHEN d.doc_id % 6 IN (3, 4) THEN 'skipped_cloud_only' ELSE 'analyzed' END AS status,
  l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def results(spark, sf_dir):
    d = corpus.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = corpus.read(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = d.join(lab, "doc_id", "left")
    error = F.when(F.col("known").isNull(), "NotProcessed").when(F.col("toxic") == 1, "bad words").when((F.col("doc_id") % 6).isin(3, 4), "SkippedCloudOnly").otherwise("")
    return rows.select(F.col("doc_id").alias("file_id"), F.lit("text").alias("analyzer_key"), analyzers.result_status(error).alias("status"), "quality", "toxic", "n_chars")


@query("p6_result_status", f"SELECT file_id, status FROM {RESULTS}")
def p6(spark, sf_dir):
    return results(spark, sf_dir).select("file_id", "status")


@query("p6_detail_json", f"""SELECT file_id, CASE WHEN quality IS NOT NULL THEN '{{"chars":"' || n_chars || '","quality":"' || quality || '"' || CASE WHEN toxic = 1 THEN ',"toxic":"1"' ELSE '' END || '}}' ELSE '{{"chars":"' || n_chars || '"}}' END AS detail FROM {RESULTS}""")
def p6_detail(spark, sf_dir):
    r = results(spark, sf_dir)
    parts = {"quality": F.col("quality"), "chars": F.col("n_chars"), "toxic": F.when(F.col("toxic") == 1, F.lit("1")).otherwise("")}
    return r.select("file_id", analyzers.detail_json(parts).alias("detail"))


@query("p5_column_recovery", f"SELECT file_id, n_chars AS char_count, quality::VARCHAR AS quality, printf('%.6f', n_chars / 7.0) AS duration FROM {RESULTS}")
def p5(spark, sf_dir):
    r = results(spark, sf_dir)
    detail = F.create_map(F.lit("quality"), F.col("quality").cast("string"))
    return r.select("file_id", F.col("n_chars").alias("char_count"), detail["quality"].alias("quality"), F.format_string("%.6f", F.col("n_chars") / F.lit(7.0)).alias("duration"))


@query(
    "a21_analyzer_counts",
    "SELECT k AS analyzer_key, ordinal, coalesce(analyzed, 0) AS analyzed, coalesce(error, 0) AS error, coalesce(skipped, 0) AS skipped_cloud_only, coalesce(not_processed, 0) AS not_processed, 0::BIGINT AS unmatched FROM (VALUES "
    + "('image', 1), ('pdf', 2), ('office', 3), ('raw_image', 4), ('audio', 5), ('video', 6), ('text', 7), ('archive', 8), ('content_extraction', 9)"
    + f") t(k, ordinal) LEFT JOIN (SELECT 'text' AS t, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped_cloud_only') AS skipped, count(*) FILTER (status = 'not_processed') AS not_processed FROM {RESULTS}) r ON r.t = k",
)
def a21(spark, sf_dir):
    return analyzers.counts(results(spark, sf_dir).select("analyzer_key", "status"), spark)


@query("a22_analyzer_totals", f"SELECT status, count(*) AS results, sum(n_chars)::BIGINT AS chars FROM {RESULTS} GROUP BY status")
def a22(spark, sf_dir):
    return results(spark, sf_dir).groupBy("status").agg(F.count("*").alias("results"), F.sum("n_chars").alias("chars"))


@query("a27_source_types", r"SELECT lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS source_type, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE NOT inaccessible GROUP BY 1")
def a27(spark, sf_dir):
    f = corpus.files(spark, sf_dir).where("status = 'observed'")
    return f.groupBy(paths.suffix(F.col("file_name")).alias("source_type")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("p14_extraction_status", "SELECT file_id, CASE WHEN cloud THEN 'skipped' WHEN inaccessible THEN 'error' WHEN size_bytes = 0 THEN 'empty' ELSE 'extracted' END AS status FROM files WHERE root_id = 1")
def p14(spark, sf_dir):
    f = corpus.files(spark, sf_dir, (1,))
    return f.select("file_id", F.when(F.col("is_offline_or_cloud"), "skipped").when(F.col("status") == "inaccessible", "error").when(F.col("size_bytes") == 0, "empty").otherwise("extracted").alias("status"))


@query("j4_results_with_files", f"SELECT f.file_id, f.relative_path, r.status, r.quality FROM files f LEFT JOIN {RESULTS} r ON r.file_id = f.file_id WHERE f.root_id IN (1, 4)")
def j4(spark, sf_dir):
    f = corpus.files(spark, sf_dir, (1, 4)).select("file_id", "relative_path")
    return f.join(results(spark, sf_dir).select("file_id", "status", "quality"), "file_id", "left")


@query("x12_flush_counters", f"SELECT count(*) AS applicable, count(*) FILTER (status = 'analyzed') AS succeeded, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status LIKE 'skipped%') AS skipped, count(*) FILTER (status = 'not_processed') AS unmatched FROM {RESULTS}")
def x12(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return results(spark, sf_dir).agg(F.count("*").alias("applicable"), n("analyzed").alias("succeeded"), n("error").alias("failed"), n("skipped_cloud_only").alias("skipped"), n("not_processed").alias("unmatched"))


@query("x13_outcome_status", f"SELECT lang, CASE WHEN n = 0 THEN 'no_applicable_files' WHEN good < n THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM (SELECT lang, count(*) AS n, count(*) FILTER (r.status = 'analyzed') AS good FROM documents d JOIN {RESULTS} r ON r.file_id = d.doc_id GROUP BY lang)")
def x13(spark, sf_dir):
    d = corpus.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    g = d.join(results(spark, sf_dir), "file_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "analyzed").alias("good"))
    return g.select("lang", analyzers.run_status(F.col("n"), F.col("good"), F.lit(False), F.lit(0)).alias("status"))


def archives(spark, sf_dir):
    """Conversations as archives, turns as their entries."""
    c = corpus.read(spark, sf_dir, "conversations")
    entry = F.struct(F.col("turn").alias("o"), F.concat(F.col("role"), F.lit("/T"), F.col("turn") % 3, F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("size"), (F.length("text") / 2).cast("long").alias("compressed"))
    rows = c.groupBy(F.col("conv_id").alias("archive_id")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("archive_id", F.transform("e", lambda x: F.struct(x["path"].alias("path"), x["size"].alias("size"), x["compressed"].alias("compressed"))).alias("entries"))


ENTRIES = "(SELECT conv_id AS archive_id, role || '/T' || (turn % 3) || '.txt' AS entry_path, length(text) AS size_bytes, length(text) // 2 AS compressed, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS sequence FROM conversations)"


@query("a26_archive_summary", f"SELECT archive_id, count(*)::INT AS entries, sum(size_bytes)::BIGINT AS bytes, sum(compressed)::BIGINT AS compressed, CASE WHEN count(*) > 3 THEN 'capped' ELSE 'complete' END AS mode, CASE WHEN sum(size_bytes) > 0 THEN printf('%.1f', 100.0 * (1 - sum(compressed)::DOUBLE / sum(size_bytes))) END AS ratio, count(*) > 3 AS truncated FROM {ENTRIES} GROUP BY archive_id")
def a26(spark, sf_dir):
    return analyzers.archive_summary(archives(spark, sf_dir), cap=3)


@query("x14_archive_members", f"SELECT archive_id, sequence::INT AS sequence, entry_path, string_split(entry_path, '/')[-1] AS entry_name, '.txt' AS extension FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, lower(entry_path) ORDER BY sequence) AS k FROM {ENTRIES} WHERE sequence <= 4) WHERE k = 1")
def x14(spark, sf_dir):
    return analyzers.archive_members(archives(spark, sf_dir), cap=4).select("archive_id", "sequence", "entry_path", "entry_name", "extension")


@query("w10_member_sequence", f"SELECT archive_id, max(sequence)::INT AS last_sequence, count(*) AS members FROM {ENTRIES} GROUP BY archive_id")
def w10(spark, sf_dir):
    rows = archives(spark, sf_dir).select("archive_id", F.posexplode("entries").alias("at", "e"))
    return rows.groupBy("archive_id").agg((F.max("at") + 1).alias("last_sequence"), F.count("*").alias("members"))


@query("j18_members_with_archive", f"SELECT e.archive_id, e.entry_path, a.n AS archive_entries FROM {ENTRIES} e JOIN (SELECT archive_id, count(*) AS n FROM {ENTRIES} GROUP BY 1) a ON a.archive_id = e.archive_id WHERE e.entry_path LIKE 'user/%'")
def j18(spark, sf_dir):
    a = archives(spark, sf_dir)
    rows = a.select("archive_id", F.size("entries").cast("long").alias("archive_entries"), F.explode("entries.path").alias("entry_path"))
    return rows.where(F.col("entry_path").startswith("user/"))


@query("j16_result_history", "SELECT doc_id AS file_id, run_id, row_number() OVER (PARTITION BY doc_id ORDER BY run_id) AS place, quality FROM labels, (VALUES (1), (3)) t(run_id)")
def j16(spark, sf_dir):
    lab = corpus.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "quality", F.explode(F.array(F.lit(1), F.lit(3))).alias("run_id"))
    return lab.select("file_id", "run_id", F.row_number().over(Window.partitionBy("file_id").orderBy("run_id")).alias("place"), "quality")


@query("f23_parse_or_null", "SELECT event_id, TRY_CAST(trim(CASE event_id % 3 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN 'x' || event_id ELSE '' END) AS BIGINT) AS as_int, nullif(trim(CASE event_id % 3 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN 'x' || event_id ELSE '' END), '') AS as_text FROM events")
def f23(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("x"), k)).otherwise("")
    return e.select("event_id", text.int_or_null(raw).alias("as_int"), text.words_or_null(raw).alias("as_text"))
