"""Current state as a fold of snapshots, with an append-only change log.

``fold(previous, snapshot, ...)`` is a pure function: a full outer join on the
location. Results are written as new versions, never updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Compared as text, null like ''.
LOOSE = ("attributes", "modified_utc")
#: Compared only where both are known.
KNOWN = ("volume_serial", "file_index")
STATE = (
    "file_id long, root_id int, root_ordinal int, relative_path string, path_sort_key string, state string, current_observation_id long, current_run_id int, first_run_id int, state_changed_run_id int, "
    "size_bytes long, modified_utc timestamp, attributes string, volume_serial string, file_index string, sha256 string, content_observation_id long, content_run_id int"
)
RUN_SPAN = 10_000_000_000_000


def differs(old: str, new: str) -> Column:
    """The change detector: size exactly, texts with null as '', physical identity where both sides know it."""
    out = ~F.col(f"{old}.size_bytes").eqNullSafe(F.col(f"{new}.size_bytes"))
    for c in LOOSE:
        out = out | (F.coalesce(F.col(f"{old}.{c}").cast("string"), F.lit("")) != F.coalesce(F.col(f"{new}.{c}").cast("string"), F.lit("")))
    for c in KNOWN:
        out = out | F.coalesce(F.col(f"{old}.{c}") != F.col(f"{new}.{c}"), F.lit(False))
    return out


def fold(previous: DataFrame, snapshot: DataFrame, run_id: int, scanned_roots: list[int], keep_verified: bool = False, unlistable: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(state after the run, observations it adds).

    Only locations below ``scanned_roots`` can go missing, and none below a
    folder that couldn't be listed. Being unreadable again is no change and
    stays unreadable. With ``keep_verified`` unchanged files get an
    observation too.
    """
    old, new = previous.alias("old"), snapshot.alias("new")
    rows = old.join(new, F.col("old.file_id") == F.col("new.file_id"), "full_outer")
    seen, known = F.col("new.file_id").isNotNull(), F.col("old.current_observation_id").isNotNull()
    lost, was = F.col("new.status") == "inaccessible", F.col("old.state")
    kind = (
        F.when(~seen, None).when(~known, "first_seen").when(lost & (was == "inaccessible"), None).when(lost, "inaccessible")
        .when(was.isin("missing", "unverified", "inaccessible"), "reappeared").when(differs("old", "new"), "modified")
    )
    if keep_verified:
        kind = F.coalesce(kind, F.when(seen, "verified"))
    hidden = F.lit(False)
    for folder in unlistable or []:
        hidden = hidden | F.startswith(F.lower("old.relative_path"), F.lit(folder.lower() + "\\"))
    gone = ~seen & F.col("old.root_id").isin(*scanned_roots) & was.isin("present", "inaccessible") & ~hidden
    state = F.when(seen, F.when(lost, "inaccessible").otherwise("present")).when(gone, "missing").otherwise(was)
    observation = F.when(kind.isNotNull(), F.lit(run_id * RUN_SPAN) + F.col("new.file_id")).otherwise(F.col("old.current_observation_id"))
    fresh = lambda c: F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    moved = ~was.eqNullSafe(state)
    rows = rows.select(
        F.coalesce("new.file_id", "old.file_id").alias("file_id"), fresh("root_id"), fresh("root_ordinal"), fresh("relative_path"), fresh("path_sort_key"), state.alias("state"), observation.alias("current_observation_id"),
        F.when(seen | gone, run_id).otherwise(F.col("old.current_run_id")).cast("int").alias("current_run_id"), F.coalesce("old.first_run_id", F.lit(run_id)).cast("int").alias("first_run_id"),
        F.when(moved, run_id).otherwise(F.col("old.state_changed_run_id")).cast("int").alias("state_changed_run_id"), *[fresh(c) for c in ("size_bytes", "modified_utc", "attributes", "volume_serial", "file_index")],
        F.col("old.sha256").alias("sha256"), F.col("old.content_observation_id").alias("content_observation_id"), F.col("old.content_run_id").alias("content_run_id"),
        kind.alias("change_kind"), F.col("old.current_observation_id").alias("supersedes_observation_id"),
    )
    observations = rows.where("change_kind is not null").select(F.col("current_observation_id").alias("observation_id"), F.lit(run_id).alias("run_id"), "file_id", "root_id", "change_kind", "supersedes_observation_id", "size_bytes")
    return rows.drop("change_kind", "supersedes_observation_id"), observations


def promote(state: DataFrame, digests: DataFrame, run_id: int) -> DataFrame:
    """Puts a run's digests (file_id, sha256) on the locations they describe now."""
    d = digests.select(F.col("file_id").alias("__f"), F.col("sha256").alias("__sha"))
    rows = state.join(d, F.col("file_id") == F.col("__f"), "left")
    hit = F.col("__sha").isNotNull() & (F.col("state") == "present")
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    changed = {"sha256": F.col("__sha"), "content_observation_id": F.col("current_observation_id"), "content_run_id": F.lit(run_id)}
    return rows.select(*[put(c, changed[c]) if c in changed else F.col(c) for c in state.columns])


def stale(state: DataFrame) -> DataFrame:
    """Present locations whose digest describes an observation that was superseded."""
    gap = F.col("content_observation_id").isNull() | (F.col("content_observation_id") != F.col("current_observation_id"))
    return state.where((F.col("state") == "present") & F.col("sha256").isNotNull() & gap)


def summary(state: DataFrame) -> DataFrame:
    kinds = ("present", "inaccessible", "missing", "unverified")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    gap = (F.col("state") == "present") & F.col("sha256").isNotNull() & F.coalesce(F.col("content_observation_id") != F.col("current_observation_id"), F.lit(True))
    return state.agg(*[count(F.col("state") == k).alias(k) for k in kinds], count(gap).alias("stale_content"), F.count("*").alias("total"))


def compacted(observations: DataFrame, state: DataFrame, members: DataFrame, runs: DataFrame, keep_runs: int) -> DataFrame:
    """Observations to remove: of runs older than the newest ``keep_runs``, but none that state, content, a duplicate group or a kept observation refers to."""
    if keep_runs <= 0:
        return observations.limit(0)
    newest = runs.orderBy(F.desc("started_utc"), F.desc("run_id")).limit(keep_runs).select("run_id")
    old = observations.join(newest, "run_id", "left_anti")
    kept = observations.join(newest, "run_id", "left_semi")
    guards = [(state, "current_observation_id"), (state, "content_observation_id"), (members, "observation_id"), (kept, "supersedes_observation_id")]
    for df, c in guards:
        old = old.join(df.where(F.col(c).isNotNull()).select(F.col(c).alias("observation_id")).distinct(), "observation_id", "left_anti")
    return old


def last_observations(observations: DataFrame, n: int = 2) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy(F.desc("run_id"), F.desc("observation_id"))
    return observations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def validate(table: DataFrame, key: list[str], name: str) -> DataFrame:
    """(rule, violations): rows beyond the first of each key."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), F.col("violations").cast("long").alias("violations"))
