"""Inventory statistics and run estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

LONG_PATH = 260
#: Seconds per file and bytes per second of the estimator (fixed values).
PER_FILE, PERSIST, EXPORT, FALLBACK_RATE = 0.0004, 0.00006, 0.00004, 5 * 1024 * 1024
SAFETY = {"network": 0.4, "local": 0.6}


def totals(files: DataFrame) -> DataFrame:
    """One row: counts, bytes, special files, exact median and mean size. Unreadable files count with size 0."""
    size = F.coalesce("size_bytes", F.lit(0)).cast("long")
    has = lambda word: F.count_if(F.contains(F.coalesce("attributes", F.lit("")), F.lit(word)))
    return files.agg(
        F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(size == 0).alias("empty_files"), F.count_if(F.col("path_length") > LONG_PATH).alias("long_paths"),
        has("Hidden").alias("hidden"), has("System").alias("system"), F.count_if("is_offline_or_cloud").alias("offline"), F.max("depth").alias("max_depth"),
        F.median(size).alias("median_size"), F.avg(size).alias("mean_size"),
    )


def by_folded(files: DataFrame, name: str, order: str = "ord") -> DataFrame:
    """Files and bytes by a name without regard to case; the spelling met first is shown."""
    size = F.coalesce("size_bytes", F.lit(0))
    return files.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, order).alias(name), F.count("*").alias("files"), F.sum(size).alias("bytes"), F.min(order).alias("first"))


def name_collisions(files: DataFrame) -> DataFrame:
    """(groups, files) of file names that occur more than once without regard to case."""
    return files.groupBy(F.lower("file_name").alias("k")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def oldest_and_newest(files: DataFrame) -> DataFrame:
    key = F.struct(F.col("modified_utc").alias("at"), F.lower("full_path").alias("folded"), F.col("full_path").alias("path"))
    rows = files.where("modified_utc is not null").agg(F.min(key).alias("o"), F.max(key).alias("n"))
    return rows.select(F.unix_seconds("o.at").alias("oldest_at"), F.col("o.path").alias("oldest_path"), F.unix_seconds("n.at").alias("newest_at"), F.col("n.path").alias("newest_path"))


def largest(files: DataFrame, n: int = 20) -> DataFrame:
    return files.orderBy(F.desc(F.coalesce("size_bytes", F.lit(0))), F.lower("full_path"), "full_path").limit(n)


def estimate(files: DataFrame, rate: float = FALLBACK_RATE, where: str = "local") -> DataFrame:
    """Work and seconds of a full and a selective run; candidates are files whose size occurs twice."""
    sizes = files.groupBy("size_bytes").agg(F.count("*").alias("n"))
    both = sizes.agg(
        F.sum("n").alias("total_files"), F.sum(F.col("size_bytes") * F.col("n")).alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("candidate_files"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("size_bytes") * F.col("n"))), F.lit(0)).alias("candidate_bytes"),
    )
    effective = rate * SAFETY[where]
    cost = lambda b, n: F.greatest(F.col(b) / F.lit(effective), F.col(n) * F.lit(PER_FILE)) + F.col(n) * F.lit(PERSIST + EXPORT)
    return both.select("*", cost("total_bytes", "total_files").alias("full_seconds"), cost("candidate_bytes", "candidate_files").alias("selective_seconds"))


def with_full_path(files: DataFrame, roots: DataFrame) -> DataFrame:
    rows = files.join(roots.select("root_id", "root_path"), "root_id")
    full = paths.join(F.col("root_path"), F.col("relative_path"))
    return rows.withColumn("full_path", full).withColumn("path_length", paths.utf16_length(full))
