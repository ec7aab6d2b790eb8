"""Per-file analyzers: a registry of what applies to what, results as promoted columns and a detail map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, render, text

PROMOTED = ("title", "author", "content_created_reported", "width_px", "height_px", "duration_seconds", "word_count", "char_count")


@dataclass(frozen=True)
class Analyzer:
    key: str
    suffixes: tuple[str, ...]
    promoted: tuple[str, ...]
    detail: tuple[str, ...]
    needs: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


#: Camera formats (fixed values).
RAW_SUFFIXES = (
    ".3fr", ".arw", ".cr2", ".cr3", ".dng", ".erf", ".iiq", ".kdc", ".mrw", ".nef", ".nrw",
    ".orf", ".pef", ".raf", ".raw", ".rw2", ".rwl", ".sr2", ".srf", ".srw", ".x3f",
)

#: What each analyzer takes and gives, in the order in which they run (fixed values).
REGISTRY = (
    Analyzer(
        "image", (".jpg", ".jpeg", ".jfif", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".ico", ".heic", ".heif", ".avif", ".jp2"),
        ("width_px", "height_px"), ("pHash", "aHash", "dHash", "Format", "HashSize"), needs=("PIL", "imagehash"), excluded=RAW_SUFFIXES,
    ),
    Analyzer("pdf", (".pdf",), ("title", "author", "content_created_reported"), ("PageCount", "IsEncrypted", "HasExtractableText", "Producer"), needs=("pypdf", "pdfplumber")),
    Analyzer("office", (".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt"), ("title", "author", "content_created_reported"), ("OfficeType", "ExtractionMode", "Modified", "ContentCount")),
    Analyzer("raw_image", RAW_SUFFIXES, ("content_created_reported",), ("CameraMake", "CameraModel", "ExposureTime", "FNumber", "ISO", "FocalLength"), needs=("exifread",)),
    Analyzer(
        "audio", (".mp3", ".wav", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".opus", ".aiff"),
        ("duration_seconds", "title"), ("Bitrate", "Codec", "SampleRate", "Channels", "Artist", "Album", "Year", "TrackNumber", "Genre"), needs=("ffprobe",),
    ),
    Analyzer(
        "video", (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp"),
        ("duration_seconds", "width_px", "height_px"), ("Bitrate", "VideoCodec", "FrameRate", "AudioCodec"), needs=("ffprobe",),
    ),
    Analyzer("text", (".txt", ".md"), ("title", "word_count", "char_count"), ("LineCount", "Encoding", "HasFrontmatter", "HeadingCount", "WikilinkCount", "TagCount")),
    Analyzer("archive", (".zip", ".7z"), (), ("EntryCount", "TotalUncompressedSize", "TotalCompressedSize", "CompressionRatioPercent")),
    Analyzer("content_extraction", (".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md"), ("word_count", "char_count"), ("SourceType", "ExtractedTextFile")),
)

#: Keys as the specifications, stored analyzers and export map state them, each by itself (fixed values).
SPEC_KEYS = ("image", "pdf", "office", "raw_image", "audio", "video", "text", "archive", "content_extraction")
STORED_KEYS = ("image", "pdf", "office", "raw_image", "audio", "video", "text", "archive", "content_extraction")
EXPORTS = {"image": "image", "pdf": "pdf", "office": "office", "raw_image": "raw_image", "audio": "audio", "video": "video", "text": "text", "archive": "archive", "content_extraction": "content_index"}


def available(analyzer: Analyzer) -> bool:
    """Whether everything the analyzer needs is installed here."""
    import importlib.util
    import shutil

    return all(shutil.which(n) or importlib.util.find_spec(n) for n in analyzer.needs)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(k, a.key, list(a.suffixes), list(a.excluded), list(a.promoted), list(a.detail)) for k, a in enumerate(REGISTRY, 1)]
    return spark.createDataFrame(rows, "ordinal int, analyzer_key string, suffixes array<string>, excluded array<string>, promoted array<string>, detail array<string>")


def by_key(key: str) -> Analyzer:
    return next(a for a in REGISTRY if a.key == key)


def applicable(files: DataFrame, analyzer: Analyzer, excluded: Column | None = None) -> DataFrame:
    """Files whose suffix the analyzer takes and that no exclusion names."""
    suffix = paths.suffix(F.col("file_name"))
    rows = files.where(suffix.isin(*analyzer.suffixes) & ~suffix.isin(*analyzer.excluded)) if analyzer.excluded else files.where(suffix.isin(*analyzer.suffixes))
    return rows.where(~excluded) if excluded is not None else rows


def selection(files: DataFrame, spark: SparkSession) -> DataFrame:
    """(analyzer_key, applicable, excluded) of every analyzer: exclusions are counted first, and are applicable to none."""
    takes = spark.createDataFrame([(a.key, s, s in a.excluded) for a in REGISTRY for s in dict.fromkeys((*a.excluded, *a.suffixes))], "analyzer_key string, suffix string, is_excluded boolean")
    found = files.groupBy(paths.suffix(F.col("file_name")).alias("suffix")).agg(F.count("*").alias("n"))
    rows = takes.join(found, "suffix", "left")  # a row for each suffix that an analyzer names
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("analyzer_key").agg(count(~F.col("is_excluded")).alias("applicable"), count(F.col("is_excluded")).alias("excluded"))


def result_status(error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) == "", "analyzed").when(error == "SkippedCloudOnly", "skipped_cloud_only").when(error == "NotProcessed", "not_processed").otherwise("error")


def detail_json(columns: dict[str, Column]) -> Column:
    """JSON of the non-empty values as strings, keys sorted; null if nothing is left."""
    kept = {k: F.nullif(v.cast("string"), F.lit("")) for k, v in sorted(columns.items())}
    return F.nullif(F.to_json(F.struct(*[v.alias(k) for k, v in kept.items()])), F.lit("{}"))


def text_stats(rows: DataFrame, body: str = "text") -> DataFrame:
    """Adds words, chars, lines and Markdown counts of a text column."""
    t = F.col(body)
    return rows.select(
        "*", text.word_count(t).alias("word_count"), F.length(t).alias("char_count"), text.line_count(t).alias("line_count"), text.headings(t).alias("headings"),
        text.inline_tags(t).alias("tags"), text.wiki_links(t).alias("wiki_links"), text.first_title(t).alias("title"), text.has_front_matter(t).alias("front_matter"),
    )


def extraction(rows: DataFrame, order: list[Column], body: str = "text") -> DataFrame:
    """Adds text_sha256 (lower case), extraction status and whether an earlier file stored the same text."""
    t = F.col(body)
    sha = F.when(F.length(t) > 0, F.sha2(F.encode(t, "UTF-8"), 256))
    status = F.when(t.isNull(), "error").when(F.length(t) == 0, "empty").otherwise("extracted")
    rows = rows.withColumn("text_sha256", sha).withColumn("status", status).withColumn("__o", F.struct(*order))
    firsts = rows.where("text_sha256 is not null").groupBy("text_sha256").agg(F.min("__o").alias("__first"))
    rows = rows.join(firsts, "text_sha256", "left")
    return rows.withColumn("reused", F.coalesce(F.col("__o") != F.col("__first"), F.lit(False))).drop("__o", "__first")


def counts(results: DataFrame, spark: SparkSession) -> DataFrame:
    """Results by analyzer and status, with a zero row for analyzers without any."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    left = registry(spark).select("ordinal", "analyzer_key")
    return left.join(results, "analyzer_key", "left").groupBy("ordinal", "analyzer_key").agg(n("analyzed"), n("error"), n("skipped_cloud_only"), n("not_processed"), n("unmatched"))


def run_status(applicable: Column, succeeded: Column, failed_early: Column, unmatched: Column) -> Column:
    return F.when(failed_early, "failed").when(applicable == 0, "no_applicable_files").when((unmatched > 0) | (succeeded < applicable), "completed_with_warnings").otherwise("completed")


def archive_members(entries: DataFrame, cap: int = 10_000) -> DataFrame:
    """One row for each member of (archive_id, entries array<struct<path,size,compressed>>): name, extension, sequence; equal paths without case once."""
    rows = entries.select("archive_id", F.posexplode("entries").alias("at", "e")).where(F.col("at") < cap)
    path = F.col("e.path")
    rows = rows.select("archive_id", (F.col("at") + 1).alias("sequence"), path.alias("entry_path"), F.col("e.size").alias("size_bytes"), F.col("e.compressed").alias("compressed_bytes"))
    name = F.substring_index(F.translate("entry_path", "\\", "/"), "/", -1)
    rows = rows.withColumn("entry_name", name).withColumn("extension", paths.extension(name))
    first = rows.groupBy("archive_id", F.lower("entry_path").alias("k")).agg(F.min("sequence").alias("sequence")).drop("k")
    return rows.join(first, ["archive_id", "sequence"], "left_semi")


def archive_summary(entries: DataFrame, cap: int = 10_000, summary_from: int = 100_000) -> DataFrame:
    """One row for each archive; sizes are sums of the known ones, and null if there are entries but none's size is known."""
    n = F.size("entries")
    known = lambda f: F.aggregate("entries", F.lit(None).cast("long"), lambda a, e: F.coalesce(a + e[f], a, e[f]))
    size = lambda f: F.when(n == 0, F.lit(0).cast("long")).otherwise(known(f))
    rows = entries.select("archive_id", n.alias("entries"), size("size").alias("bytes"), size("compressed").alias("compressed"), F.when(n > summary_from, "summary_only").when(n > cap, "capped").otherwise("complete").alias("mode"))
    ratio = F.when(F.col("bytes") > 0, render.fixed(100.0 * (1 - F.col("compressed") / F.col("bytes")), 1))
    return rows.select("*", ratio.alias("ratio"), (F.col("mode") != "complete").alias("truncated"))
