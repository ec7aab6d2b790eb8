"""CSV dialects, artifacts, reports and the content store."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, render
from ..sources.store import Table, filesystem

BOM = "﻿"


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def cell(c: Column, dialect: str) -> Column:
    """powershell quotes everything but nulls; minimal quotes what needs it."""
    text = c.cast("string")
    if dialect == "powershell":
        return F.when(text.isNull(), "").otherwise(quoted(text))
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), quoted(text)).otherwise(text)


def lines(df: DataFrame, dialect: str = "powershell") -> DataFrame:
    """One column ``value``: each row as a CSV line."""
    return df.select(F.array_join(F.array(*[cell(F.col(c), dialect) for c in df.columns]), ",").alias("value"))


def header(columns: Iterable[str], dialect: str) -> str:
    return ",".join(f'"{c}"' if dialect == "powershell" else c for c in columns)


def write_csv(df: DataFrame, path: str, order: list[Column], dialect: str = "powershell", forbidden: str | None = None) -> int:
    """Streams a sorted relation into one CSV file on the driver; no rows, no file. Returns the rows written.

    Rows pass through an iterator, a partition at a time; the file appears
    under its name only when it is complete.
    """
    if forbidden and os.path.commonpath([os.path.abspath(path), os.path.abspath(forbidden)]) == os.path.abspath(forbidden):
        raise ValueError(f"exports don't go into the run folder {forbidden}")
    rows = lines(df.orderBy(*order), dialect).toLocalIterator()
    first = next(rows, None)
    if first is None:
        return 0
    n = 0
    with open(path + ".partial", "w", encoding="utf-8", newline="") as f:
        f.write((BOM if dialect == "powershell" else "") + header(df.columns, dialect) + "\r\n")
        while first is not None:
            f.write(first["value"] + "\r\n")
            n += 1
            first = next(rows, None)
    os.replace(path + ".partial", path)
    return n


def export_all(artifacts: dict[str, tuple[DataFrame, list[Column]]], folder: str, dialect: str = "powershell") -> dict[str, dict]:
    """Writes each artifact; says what was written, what was empty, and the row counts."""
    os.makedirs(folder, exist_ok=True)
    counts = {name: write_csv(df, f"{folder}/{name}.csv", order, dialect) for name, (df, order) in artifacts.items()}
    return {"written": [k for k, n in counts.items() if n], "skipped": [k for k, n in counts.items() if not n], "row_counts": counts}


#: artifact, file, dialect, columns, equivalence, scope (fixed values).
OUTPUTS = (
    ("preliminary_inventory", "PreliminaryInventory.csv", "powershell", 14, "byte", "run"),
    ("potential_duplicates", "PotentialDuplicates.csv", "powershell", 6, "byte", "duplicate_run"),
    ("partial_hash_candidates", "PartialHashCandidates.csv", "powershell", 10, "byte", "duplicate_run"),
    ("full_hash_inventory", "FullHashInventory.csv", "powershell", 17, "byte", "duplicate_run"),
    ("duplicate_hash_inventory", "DuplicateHashInventory.csv", "powershell", 18, "byte", "duplicate_run"),
    ("image", "ImageHashes.csv", "python", 10, "byte", "analyzer_run"),
    ("pdf", "PDFInventory.csv", "python", 11, "byte", "analyzer_run"),
    ("office", "OfficeInventory.csv", "python", 11, "byte", "analyzer_run"),
    ("raw_image", "RawImageInventory.csv", "python", 11, "byte", "analyzer_run"),
    ("audio", "AudioInventory.csv", "python", 15, "byte", "analyzer_run"),
    ("video", "VideoInventory.csv", "python", 11, "byte", "analyzer_run"),
    ("text", "TextFileInventory.csv", "python", 13, "byte", "analyzer_run"),
    ("archive", "ArchiveInventory.csv", "python", 8, "byte", "analyzer_run"),
    ("archive_contents", "ArchiveContents.csv", "python", 5, "byte", "analyzer_run"),
    ("content_index", "ContentIndex.csv", "python", 8, "byte", "analyzer_run"),
    ("canonical_inventory", "Inventory-Canonical.csv", "python", 32, "data", "project"),
    ("current_duplicates", "Duplicates-Current.csv", "python", 12, "data", "project"),
)
CLASSIFICATION = "A-canonical"


def output_map(spark: SparkSession) -> DataFrame:
    """Every artifact as a row; which operator produces it is the artifact's own name."""
    rows = [(k, *o, CLASSIFICATION) for k, o in enumerate(OUTPUTS, 1)]
    return spark.createDataFrame(rows, "ordinal int, artifact string, file string, dialect string, columns int, equivalence_target string, scope string, classification string")


def stage_artifacts(stage: str) -> list[str]:
    """The artifacts of a stage's export: the hash stage's, one analyzer's, or all."""
    if stage == "hash":
        return [o[0] for o in OUTPUTS if o[5] == "duplicate_run"]
    if stage == "all":
        return [o[0] for o in OUTPUTS]
    own = {"archive": ["archive", "archive_contents"], "content_extraction": ["content_index"]}.get(stage, [stage])
    return [o[0] for o in OUTPUTS if o[0] in own and o[5] == "analyzer_run"]


def write_report(rows: Iterable[str], path: str) -> None:
    """Report lines with byte order mark and CR LF; nothing is written for no lines."""
    rows = list(rows)
    if rows:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(BOM + "".join(r + "\r\n" for r in rows))


def store_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Puts each distinct text into ``ab/cd/<sha>.txt`` below ``folder``, which all executors see; (file_id, text_sha256, storage, reused).

    What is in the store already is left as it is, whichever call put it there.
    A file appears under its name only when it is complete, so two tasks with
    the same text do no harm. ``reused`` says that an earlier call or a file
    with a smaller id had the text first. Texts are written where they are read.
    """
    rows = texts.where("text is not null").select("file_id", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    firsts = rows.groupBy("text_sha256").agg(F.min("file_id").alias("first"))
    named = firsts.select("text_sha256", "first", paths.shard_path(F.col("text_sha256")).alias("storage"))

    def look(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            kinds = [x.type for x in fs.get_file_info([f"{root}/{p}" for p in batch.column(2).to_pylist()])] if batch.num_rows else []
            there = pa.array([k == pa.fs.FileType.File for k in kinds], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, there], names=[*batch.schema.names, "there"])

    known = Table(named.mapInArrow(look, "text_sha256 string, first long, storage string, there boolean"), "stored-texts").df

    def put(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            n = 0
            for text, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{path}"
                if fs.get_file_info(target).type == pa.fs.FileType.File:
                    continue
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                staging = f"{target}.{uuid.uuid4().hex}.partial"
                with fs.open_output_stream(staging, compression=None) as f:
                    f.write(text.as_buffer())
                fs.move(staging, target)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("text", paths.shard_path(F.col("text_sha256")).alias("path")).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    out = rows.select("file_id", "text_sha256").join(known, "text_sha256")
    return out.select("file_id", "text_sha256", "storage", (F.col("there") | (F.col("file_id") != F.col("first"))).alias("reused"))


def preliminary_report(totals: DataFrame, top_files: DataFrame, top_folders: DataFrame) -> list[str]:
    """A page of at most a few dozen lines."""
    t = totals.withColumn("shown", render.human_bytes(F.col("bytes"))).first()
    out = ["PRELIMINARY REPORT", f"Files: {t['files']:,}", f"Total size: {t['shown']} ({t['bytes']:,} bytes)", f"Empty files: {t['empty_files']:,}", f"Long paths: {t['long_paths']:,}", f"Deepest level: {t['max_depth']}"]
    out += ["", "LARGEST FILES"] + [f"{r['size_bytes']:>16,}  {r['full_path']}" for r in top_files.collect()]
    return out + ["", "LARGEST FOLDERS"] + [f"{r['bytes']:>16,}  {r['folder']}" for r in top_folders.collect()]


def duplicate_report(groups: DataFrame) -> list[str]:
    """Totals and the twenty groups with the most to gain."""
    t = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("redundant_count"), F.lit(0)).alias("r"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("b"))
    t = t.withColumn("shown", render.human_bytes(F.col("b"))).first()
    out = ["DUPLICATE REPORT", f"Groups: {t['n']:,}", f"Redundant files: {t['r']:,}", f"Reclaimable: {t['shown']}"]
    top = groups.orderBy(F.desc("reclaimable_bytes"), "duplicate_group_id").limit(20).collect()
    return out + [f"Group {r['duplicate_group_id']}: {r['member_count']} files, {r['reclaimable_bytes']:,} bytes ({r['method']})" for r in top]
