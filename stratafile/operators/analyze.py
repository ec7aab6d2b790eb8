"""Runs an analyzer over files: what it needs is looked for first, and a file that fails is a row, never an end.

An outcome is ``no_applicable_files`` if there is nothing to do, ``failed``
with a reason and no rows if a library or program is missing where there is
something to do, else a frame of one row for each applicable file. Libraries
are imported in the tasks, so one that is missing touches its own analyzer alone.
"""

from __future__ import annotations

import importlib.util
import io
import json
import os
import shutil
import subprocess
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import containers
from . import analyzers

#: Seconds that a media probe may take (fixed value).
PROBE_SECONDS = 60
RESULT = "file_id long, analyzer_key string, fields map<string,string>, error string"


@dataclass
class Outcome:
    key: str
    status: str
    applicable: int
    excluded: int
    reason: str = ""
    results: DataFrame | None = None


def missing(key: str) -> list[str]:
    """The libraries and programs that an analyzer needs and this machine hasn't."""
    return [n for n in analyzers.by_key(key).needs if not (shutil.which(n) or importlib.util.find_spec(n))]


def probe(path: str, command: tuple[str, ...] = ("ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams"), seconds: float = PROBE_SECONDS) -> dict:
    """What a media probe says of a file; an error if it fails or takes too long."""
    try:
        done = subprocess.run([*command, path], capture_output=True, text=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired as e:
        raise RuntimeError(f"the probe took more than {seconds:g} seconds") from e
    if done.returncode:
        raise RuntimeError(f"ffprobe failed: {done.stderr.strip()[:200]}")
    return json.loads(done.stdout)


def _stream(told: dict, kind: str) -> dict:
    return next((s for s in told.get("streams", []) if s.get("codec_type") == kind), {})


def rate(fraction: str) -> str:
    """A frame rate given as a fraction, with two decimals; '' if there is none."""
    above, _, below = (fraction or "").partition("/")
    try:
        return f"{float(above) / float(below or 1):.2f}"
    except (ValueError, ZeroDivisionError):
        return ""


def read_image(path: str, side: int = 8) -> dict:
    from PIL import Image

    with Image.open(path) as img:
        grey = containers.grey_matrix(img.convert("L"))
        return {
            "Width": img.size[0], "Height": img.size[1], "Format": img.format, "HashSize": side,
            "pHash": containers.perceptual_hash(grey, side), "aHash": containers.average_hash(grey, side), "dHash": containers.difference_hash(grey, side),
        }


def read_pdf(path: str) -> dict:
    import pypdf

    pdf = pypdf.PdfReader(path)
    told = pdf.metadata or {}
    try:
        has_text = str(bool((pdf.pages[0].extract_text() or "").strip())) if len(pdf.pages) else "Unknown"
    except Exception:  # encrypted and damaged pages still have a row
        has_text = "Unknown"
    return {
        "PageCount": len(pdf.pages), "IsEncrypted": pdf.is_encrypted, "HasExtractableText": has_text, "Title": told.get("/Title"), "Author": told.get("/Author"),
        "Producer": told.get("/Producer"), "CreationDate": told.get("/CreationDate"),
    }


def read_office(path: str) -> dict:
    suffix = os.path.splitext(path)[1].lower()
    with open(path, "rb") as f:
        content = f.read()
    if suffix in (".docx", ".xlsx", ".pptx"):
        told = containers.ooxml_properties(content)
        parts = containers.ooxml_text(content, suffix).split("\n")
        return {"OfficeType": suffix[1:].upper(), "ExtractionMode": "Full", "Title": told.get("title"), "Author": told.get("creator"), "Created": told.get("created"), "Modified": told.get("modified"), "ContentCount": sum(1 for p in parts if p)}
    if content[:5] == b"{\\rtf":
        told = containers.rtf_info(content.decode("latin-1"))
        return {"OfficeType": suffix[1:].upper(), "ExtractionMode": "MetadataOnly", "Title": told.get("title"), "Author": told.get("author"), "Created": told.get("creatim"), "Modified": told.get("revtim")}
    import olefile

    with olefile.OleFileIO(io.BytesIO(content)) as ole:
        m = ole.get_metadata()
        text = lambda x: x.decode(f"cp{m.codepage or 1252}", "replace") if isinstance(x, bytes) else x
        return {"OfficeType": suffix[1:].upper(), "ExtractionMode": "MetadataOnly", "Title": text(m.title), "Author": text(m.author), "Created": m.create_time, "Modified": m.last_saved_time}


def read_raw(path: str) -> dict:
    import exifread

    with open(path, "rb") as f:
        tags = exifread.process_file(f, details=False)
    names = {
        "CameraMake": "Image Make", "CameraModel": "Image Model", "ExposureTime": "EXIF ExposureTime", "FNumber": "EXIF FNumber", "ISO": "EXIF ISOSpeedRatings",
        "FocalLength": "EXIF FocalLength", "DateTimeOriginal": "EXIF DateTimeOriginal",
    }
    return {k: tags.get(n) for k, n in names.items()}


def read_audio(path: str) -> dict:
    told = probe(path)
    whole, sound = told.get("format", {}), _stream(told, "audio")
    tags = {k.lower(): v for k, v in (whole.get("tags") or {}).items()}
    return {
        "DurationSeconds": whole.get("duration"), "Bitrate": whole.get("bit_rate"), "Codec": sound.get("codec_name"), "SampleRate": sound.get("sample_rate"), "Channels": sound.get("channels"), "Title": tags.get("title"),
        "Artist": tags.get("artist"), "Album": tags.get("album"), "Year": tags.get("date"), "TrackNumber": tags.get("track"), "Genre": tags.get("genre"),
    }


def read_video(path: str) -> dict:
    told = probe(path)
    whole, picture, sound = told.get("format", {}), _stream(told, "video"), _stream(told, "audio")
    return {
        "DurationSeconds": whole.get("duration"), "Bitrate": whole.get("bit_rate"), "VideoCodec": picture.get("codec_name"), "Width": picture.get("width"), "Height": picture.get("height"),
        "FrameRate": rate(picture.get("r_frame_rate", "")), "AudioCodec": sound.get("codec_name"),
    }


def read_archive(path: str) -> dict:
    if path.lower().endswith(".7z"):
        import py7zr

        with py7zr.SevenZipFile(path) as z:
            sizes = [(e.uncompressed or 0, e.compressed or 0) for e in z.list() if not e.is_directory]
    else:
        with zipfile.ZipFile(path) as z:
            sizes = [(e.file_size, e.compress_size) for e in z.infolist() if not e.is_dir()]
    whole, packed = sum(a for a, _ in sizes), sum(b for _, b in sizes)
    return {"EntryCount": len(sizes), "TotalUncompressedSize": whole, "TotalCompressedSize": packed, "CompressionRatioPercent": f"{100 * (1 - packed / whole):.1f}" if whole else ""}


def text_of(path: str) -> tuple[str, str]:
    """(kind, text) of a document."""
    suffix = os.path.splitext(path)[1].lower()
    with open(path, "rb") as f:
        content = f.read()
    if suffix == ".pdf":
        import pypdf

        return "PDF", "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)
    if suffix in (".docx", ".pptx", ".xlsx"):
        return suffix[1:].upper(), containers.ooxml_text(content, suffix)
    return "PlainText", containers.decode_bytes(content)[0]


def read_text(path: str) -> dict:
    with open(path, "rb") as f:
        text, encoding = containers.decode_bytes(f.read())
    return {"Text": text, "Encoding": encoding}


def read_content(path: str) -> dict:
    kind, text = text_of(path)
    return {"Text": text, "SourceType": kind}


READERS: dict[str, Callable[[str], dict]] = {
    "image": read_image, "pdf": read_pdf, "office": read_office, "raw_image": read_raw, "audio": read_audio, "video": read_video, "text": read_text, "archive": read_archive, "content_extraction": read_content,
}


def ordinary(message: str) -> str:
    """A message without the prefixes that lift path limits; the network form first."""
    return message.replace("\\\\?\\UNC\\", "\\\\").replace("\\\\?\\", "")


def run(files: DataFrame, key: str, reader: Callable[[str], dict] | None = None, absent: list[str] | None = None, skip_cloud: bool = True) -> Outcome:
    """Analyzes ``files`` (file_id, path, file_name, is_offline_or_cloud); ``path`` is one that the tasks can open."""
    analyzer = analyzers.by_key(key)
    counts = analyzers.selection(files, files.sparkSession).where(F.col("analyzer_key") == key).first()
    if not counts["applicable"]:
        return Outcome(key, "no_applicable_files", 0, counts["excluded"])
    gone = missing(key) if absent is None else absent
    if gone:
        return Outcome(key, "failed", counts["applicable"], counts["excluded"], f"missing: {', '.join(gone)}")
    read = reader or READERS[key]

    def work(batches):
        for batch in batches:
            out = []
            for file_id, path, cloud in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if cloud and skip_cloud:
                    out.append((file_id, key, [], "SkippedCloudOnly"))
                    continue
                try:
                    fields = [(k, str(v)) for k, v in read(path).items() if v is not None]
                    out.append((file_id, key, fields, ""))
                except Exception as e:  # a file's own failure: its row says so and the next file is read
                    out.append((file_id, key, [], ordinary(" ".join(str(e).split())) or type(e).__name__))
            types = (pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file_id", "analyzer_key", "fields", "error"])

    rows = analyzers.applicable(files, analyzer).select("file_id", "path", F.coalesce("is_offline_or_cloud", F.lit(False)).alias("cloud"))
    return Outcome(key, "running", counts["applicable"], counts["excluded"], results=rows.mapInArrow(work, RESULT))


def finished(results: DataFrame) -> DataFrame:
    """(analyzer_key, applicable, succeeded, errors, skipped, status) of written results."""
    kind = analyzers.result_status(F.col("error"))
    n = lambda s: F.count_if(kind == s)
    rows = results.groupBy("analyzer_key").agg(F.count("*").alias("applicable"), n("analyzed").alias("succeeded"), n("error").alias("errors"), n("skipped_cloud_only").alias("skipped"))
    return rows.withColumn("status", F.when(F.col("errors") > 0, "completed_with_warnings").otherwise("completed"))


#: Result fields and the columns that they are promoted to (fixed values).
PROMOTED_FROM = {
    "Title": "title", "Author": "author", "CreationDate": "content_created_reported", "Created": "content_created_reported", "DateTimeOriginal": "content_created_reported",
    "Width": "width_px", "Height": "height_px", "DurationSeconds": "duration_seconds", "WordCount": "word_count", "CharCount": "char_count",
}


def promoted(results: DataFrame) -> DataFrame:
    """Results with the shared columns beside the other fields; a value that isn't of its column's type is null."""
    kinds = {"width_px": "long", "height_px": "long", "duration_seconds": "double", "word_count": "long", "char_count": "long"}
    of: dict[str, list[Column]] = {}
    for field, column in PROMOTED_FROM.items():
        of.setdefault(column, []).append(F.nullif(F.trim(F.try_element_at("fields", F.lit(field))), F.lit("")))
    columns = [F.coalesce(*v).try_cast(kinds.get(c, "string")).alias(c) for c, v in of.items()]
    detail = F.map_filter("fields", lambda k, v: ~k.isin(*PROMOTED_FROM))
    return results.select("file_id", "analyzer_key", *columns, detail.alias("detail"), "error")
