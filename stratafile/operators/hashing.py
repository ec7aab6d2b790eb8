"""Content identity: size, then the first bytes, then the whole file.

``rows`` are files with their bodies in ``text``; ``ord`` is the presentation
order, ``walk`` the order of the walk. A body is read where it lies and never
crosses an exchange: metadata is written first, the candidates it gives are
broadcast if they were counted to be few, and one pass over the bodies emits
keys and digests. Beyond that bound the pass digests every body and the
candidates are joined to the narrow digests, which costs reads but no shuffle
of bodies. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.store import Table, few
from .ranking import numbered

#: Bytes of the first digest (fixed value).
WINDOW = 65_536
#: Status names (fixed values).
PARTIAL = {"out": "RuledOut", "same": "ConfirmedDuplicate", "more": "NeedsFullHash", "cloud": "SkippedCloudOnly", "error": "Error"}
FINAL = {"size": "UniqueBySize", "partial": "RuledOutByPartialHash", "full": "RuledOutByFullHash", "same": "ConfirmedDuplicate", "hash": "UniqueByHash"}
STORED = {
    "UniqueBySize": "size_unique", "RuledOutByPartialHash": "ruled_out_partial", "RuledOutByFullHash": "ruled_out_full",
    "ConfirmedDuplicate": "confirmed_duplicate", "UniqueByHash": "unique_by_hash", "SkippedCloudOnly": "skipped_cloud_only", "Error": "error",
}


def stored_status(final: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STORED.items() for x in pair])[final], F.lit("unknown"))


def digest(content: Column, window: int | None = None) -> Column:
    data = F.encode(content, "UTF-8")
    return F.upper(F.sha2(F.substring(data, 1, window) if window else data, 256))


def entries(rows: DataFrame) -> DataFrame:
    """Adds ``size_bytes``, ``cloud``, ``ord`` and ``walk`` to readable corpus rows."""
    from ..functions import attrs
    from ..sources.corpus import ORDINALS

    ordinal = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])[F.col("root_id")]
    rel = F.col("relative_path")
    return rows.where(~F.col("inaccessible")).select(
        "file_id", "root_id", "relative_path", F.octet_length("text").cast("long").alias("size_bytes"), attrs.is_cloud(F.col("attribute_word")).alias("cloud"),
        F.struct(ordinal.alias("o"), paths.sort_key(rel).alias("s"), F.col("file_id").alias("f")).alias("ord"),
        F.struct(F.col("root_id").alias("r"), paths.walk_key(rel).alias("w"), F.col("file_id").alias("f")).alias("walk"), "text",
    )


def size_groups(files: DataFrame) -> DataFrame:
    """(size_bytes, members, reclaim, size_group_id) of sizes that at least two files have; largest gain first."""
    groups = files.groupBy("size_bytes").agg(F.count("*").alias("members"), F.min("ord").alias("first")).where("members > 1")
    groups = Table(groups.withColumn("reclaim", F.col("size_bytes") * (F.col("members") - 1)), "sizes").df
    return numbered(groups, "size_group_id", [F.desc("reclaim"), F.col("first")]).drop("first")


def digested(files: DataFrame, wanted: DataFrame, on: str, name: str, keep: list[str], window: int | None = None) -> DataFrame:
    """``keep`` and the digest ``name`` of the files whose ``on`` is in ``wanted`` (a written table), written once."""
    code = digest(F.col("text"), window).alias(name)
    if few(wanted):
        own = [c for c in keep if c not in wanted.columns]
        rows = files.select(*dict.fromkeys([on, *own, "text"])).join(F.broadcast(wanted), on)
        return Table(rows.select(*wanted.columns, *own, code), name).df
    every = Table(files.select(*dict.fromkeys([on, *keep]), code), name).df
    return every.join(wanted, on)


def selective(files: DataFrame, window: int = WINDOW, skip_cloud: bool = True) -> DataFrame:
    """One row for each of ``files`` (:func:`entries`) with its groups, digests and verdicts."""
    meta = Table(files.select("file_id", "size_bytes", "cloud", "ord", "walk"), "metadata").df
    local = meta.where(~F.col("cloud")) if skip_cloud else meta
    bodies = files.where(~F.col("cloud")) if skip_cloud else files
    groups = Table(size_groups(local).select("size_bytes", "size_group_id"), "size-groups").df
    hashed = digested(bodies, groups, "size_bytes", "partial_hash", ["file_id", "walk"], window)
    place = F.struct("size_group_id", "walk")
    buckets = hashed.groupBy("size_group_id", "partial_hash").agg(F.count("*").alias("m"), F.min(place).alias("first"), (F.max("size_bytes") <= window).alias("covered")).where("m > 1").drop("m")
    buckets = Table(numbered(Table(buckets, "buckets").df, "partial_group_id", [F.col("first")]), "partial-groups").df
    found = hashed.join(buckets, ["size_group_id", "partial_hash"], "left")
    status = F.when(F.col("partial_group_id").isNull(), PARTIAL["out"]).when(F.col("covered"), PARTIAL["same"]).otherwise(PARTIAL["more"])
    found = Table(found.select("file_id", "size_group_id", "walk", "partial_hash", "partial_group_id", status.alias("partial_status")), "partial-status").df
    again = found.where(F.col("partial_status") == PARTIAL["more"]).select("file_id", "partial_group_id", "size_group_id", "walk")
    again = Table(again, "needs-full-hash").df
    flat = buckets.where("covered").select(F.lit(0).alias("stage"), "partial_group_id", F.lit(None).cast("string").alias("full_hash"), "first")
    if again.isEmpty():
        fulls = again.withColumn("full_hash", F.lit(None).cast("string"))
        dups = flat
    else:
        fulls = digested(bodies.where(F.col("size_bytes") > window), again, "file_id", "full_hash", ["file_id"])
        deep = fulls.groupBy("partial_group_id", "full_hash").agg(F.count("*").alias("m"), F.min(place).alias("first")).where("m > 1")
        dups = Table(flat.unionByName(deep.select(F.lit(1).alias("stage"), "partial_group_id", "full_hash", "first")), "confirmed").df
    dups = numbered(dups, "duplicate_group_id", [F.col("stage"), F.col("first")])
    dups = dups.select(F.col("partial_group_id").alias("__p"), F.col("full_hash").alias("__h"), "duplicate_group_id")
    found = found.drop("walk").join(fulls.select("file_id", "full_hash"), "file_id", "left")
    found = found.join(dups, (F.col("partial_group_id") == F.col("__p")) & F.col("full_hash").eqNullSafe(F.col("__h")), "left").drop("__p", "__h")
    out = meta.select("file_id", "size_bytes", "cloud").join(found, "file_id", "left")
    final = (
        F.when(F.col("cloud") & F.lit(skip_cloud), PARTIAL["cloud"]).when(F.col("size_group_id").isNull(), FINAL["size"]).when(F.col("partial_status") == PARTIAL["out"], FINAL["partial"])
        .when(F.col("duplicate_group_id").isNotNull(), FINAL["same"]).when(F.col("partial_status") == PARTIAL["more"], FINAL["full"]).otherwise(PARTIAL["error"])
    )
    return out.select("file_id", "size_bytes", "size_group_id", "partial_hash", "partial_group_id", "partial_status", "full_hash", final.alias("final_status"), "duplicate_group_id")


def exhaustive(files: DataFrame, skip_cloud: bool = True) -> DataFrame:
    """Every readable file's full digest; groups numbered by first appearance."""
    hashed = Table(files.select("file_id", "size_bytes", "ord", F.when(~(F.col("cloud") & F.lit(skip_cloud)), digest(F.col("text"))).alias("full_hash")), "digests").df
    known = hashed.where("full_hash is not null")
    groups = known.groupBy("full_hash").agg(F.count("*").alias("m"), F.min("ord").alias("first")).where("m > 1")
    groups = numbered(Table(groups, "groups").df, "duplicate_group_id", [F.col("first")]).select("full_hash", "duplicate_group_id")
    out = known.join(groups, "full_hash", "left").select("file_id", "size_bytes", "full_hash", "duplicate_group_id")
    # files without a digest aren't a join key of their own: they would all meet in one task
    rest = hashed.where("full_hash is null").select("file_id", "size_bytes", "full_hash", F.lit(None).cast("long").alias("duplicate_group_id"))
    final = F.when(F.col("full_hash").isNull(), PARTIAL["cloud"]).when(F.col("duplicate_group_id").isNotNull(), FINAL["same"]).otherwise(FINAL["hash"])
    return out.unionByName(rest).select("file_id", "size_bytes", "full_hash", final.alias("final_status"), "duplicate_group_id")


def identity(full: Column, partial: Column, size: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """(sha256, source): a partial digest only counts if the window covers the file."""
    covered = partial.isNotNull() & (size <= window)
    return F.when(full.isNotNull(), full).when(covered, partial), F.when(full.isNotNull(), "full_hash").when(covered, "partial_hash_complete")


def duplicate_groups(results: DataFrame) -> DataFrame:
    """(duplicate_group_id, member_count, redundant_count, reclaimable_bytes, method) of a run's results."""
    method = F.when(F.max("full_hash").isNotNull(), "FullHash").otherwise("PartialHash")
    rows = results.where("duplicate_group_id is not null").groupBy("duplicate_group_id")
    return rows.agg(F.count("*").alias("member_count"), (F.count("*") - 1).alias("redundant_count"), (F.max("size_bytes") * (F.count("*") - 1)).alias("reclaimable_bytes"), method.alias("method"))
