"""Text sources of the ledger: stage events as JSON lines, error files, captured console output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import capped

EVENT_SCHEMA = "event_utc string, severity string, category string, source string, stage_key string, file_path string, message string, error_type string, continued boolean, file_skipped boolean, retryable boolean, detail string, _bad string"
#: A line of the error file; of console output (fixed values).
ERROR_LINE = r"^(DIRECTORY ACCESS ERROR|FILE ERROR):\s*(.*?)\s+--\s+(.*)$"
CONSOLE_ERROR = r"(?i)^\s*(ERROR|FATAL|CRITICAL)\b[:\s]"
CONSOLE_WARNING = r"(?i)^\s*(WARNING|WARN)\b[:\s]"
#: Events made of one stream at most (fixed value).
CAP = 200


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of an NDJSON file; a line that can't be read becomes a warning, never an error."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return mark_bad(rows)


def mark_bad(rows: DataFrame) -> DataFrame:
    bad = F.col("_bad").isNotNull()
    return rows.withColumn("severity", F.when(bad, "warning").otherwise(F.col("severity"))).withColumn("message", F.when(bad, F.concat(F.lit("unreadable event line: "), "_bad")).otherwise(F.col("message"))).drop("_bad")


def error_fields(line: Column) -> tuple[Column, Column, Column]:
    """(kind, path, message) of ``KIND: path -- message``; kind '' if the line is something else."""
    return tuple(F.regexp_extract(line, ERROR_LINE, k) for k in (1, 2, 3))


def error_events(lines: DataFrame, by: list[str], order: list[Column], cap: int = CAP) -> DataFrame:
    """Events of the lines (``line``) of error files, a file for each group of ``by``.

    Blank lines are none. A line of another shape is kept as a warning with the
    whole line as its message. Of ``cap`` lines or more the first ``cap`` become
    events and one more says so.
    """
    text = F.trim(F.regexp_replace("line", "^\ufeff", ""))
    rows = lines.withColumn("line", text).where("line <> ''")
    placed = capped(rows, by, order, cap)
    kind, where, what = error_fields(F.col("line"))
    known = kind != ""
    shown = placed.select(
        *by, F.col("place").alias("line_no"), F.lit("warning").alias("severity"), F.when(known, kind).alias("error_type"), F.when(known, where).alias("file_path"),
        F.when(known, what).otherwise(F.col("line")).alias("message"), F.lit(True).alias("continued"), F.when(known, True).alias("file_skipped"), F.when(known, True).alias("retryable"),
    )
    none = F.lit(None)
    last = placed.where((F.col("place") == cap) & (F.col("seen") >= cap)).select(
        *by, F.lit(cap + 1).cast("long").alias("line_no"), F.lit("info").alias("severity"), none.cast("string").alias("error_type"), none.cast("string").alias("file_path"),
        F.lit(f"Only the first {cap} entries were recorded as events; the full list remains in the file.").alias("message"), F.lit(True).alias("continued"), none.cast("boolean").alias("file_skipped"), none.cast("boolean").alias("retryable"),
    )
    return shown.unionByName(last)


def read_errors(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """Events of an error file, with the place of each line."""
    rows = spark.read.text(path).select(F.lit(path).alias("source"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return error_events(rows, ["source"], [F.col("at")], cap).drop("source")


def console_severity(line: Column) -> Column:
    """error, warning or null for a captured line."""
    return F.when(line.rlike(CONSOLE_ERROR), "error").when(line.rlike(CONSOLE_WARNING), "warning").when(line.rlike(r"^Traceback \(most recent call last\)"), "error")


def single_line(message: Column) -> Column:
    return F.trim(F.regexp_replace(message, r"\s+", " "))
