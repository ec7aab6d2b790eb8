"""Duplicate questions over current state: location, physical object and content stay three things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def eligible(state: DataFrame) -> DataFrame:
    """Present locations whose digest describes what is there now."""
    fresh = F.col("content_observation_id") == F.col("current_observation_id")
    key = F.when(F.col("volume_serial").isNotNull() & F.col("file_index").isNotNull(), F.concat_ws(":", "volume_serial", "file_index"))
    return state.where((F.col("state") == "present") & F.col("sha256").isNotNull() & fresh).withColumn("physical_key", key)


def current_sets(state: DataFrame, min_locations: int = 2) -> DataFrame:
    """One row for each content in at least ``min_locations`` places; reclaimable bytes are unknown unless every physical object is known."""
    groups = eligible(state).groupBy("sha256").agg(
        F.max("size_bytes").alias("size_bytes"), F.count("*").alias("location_count"), F.countDistinct("root_id").alias("root_count"),
        F.count("physical_key").alias("known"), F.countDistinct("physical_key").alias("copies"),
    )
    groups = groups.where(F.col("location_count") >= min_locations)
    complete = F.col("known") == F.col("location_count")
    return groups.select(
        "sha256", "size_bytes", "location_count", "root_count", F.when(complete, F.col("copies")).alias("physical_copy_count"),
        F.when(complete, F.col("location_count") - F.col("copies")).alias("hard_link_alias_count"), complete.alias("physical_identity_complete"),
        F.when(complete, (F.col("copies") - 1) * F.coalesce("size_bytes", F.lit(0))).alias("reclaimable_bytes"),
    )


def member_rank(state: DataFrame) -> DataFrame:
    """Locations of every current duplicate set, ranked by presentation order."""
    rows = eligible(state)
    wanted = current_sets(state).select("sha256")
    order = [F.col(c) for c in ("root_ordinal", "path_sort_key", "file_id")]
    rows = rows.join(wanted, "sha256", "left_semi").select("sha256", "file_id", "root_id", "relative_path", "root_ordinal", "path_sort_key")
    return ranked(rows, "member_rank", ["sha256"], order).drop("root_ordinal", "path_sort_key")


def historical_sets(measured: DataFrame) -> DataFrame:
    """Contents that at least two locations have ever had."""
    return measured.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"), F.countDistinct("file_id").alias("location_count")).where("location_count > 1")
