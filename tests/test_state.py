"""Folding scans into state."""

import datetime

from stratafile.operators import state
from stratafile.operators.duplicates import current_sets

SNAP = "file_id long, root_id int, root_ordinal int, relative_path string, path_sort_key string, size_bytes long, modified_utc timestamp, attributes string, volume_serial string, file_index string, status string"
T0 = datetime.datetime(2024, 1, 1)


def snap(spark, *files):
    return spark.createDataFrame([(i, 1, 1, p, p, None if s == "inaccessible" else n, T0, "Archive", "1", str(i), s) for i, p, n, s in files], SNAP)


def states(df):
    return {r["file_id"]: r["state"] for r in df.collect()}


def kinds(df):
    return {r["file_id"]: r["change_kind"] for r in df.collect()}


def test_change_vanish_reappear(spark):
    a, b = (1, "a", 5, "observed"), (2, "b", 5, "observed")
    s1, o1 = state.fold(spark.createDataFrame([], state.STATE), snap(spark, a, b), 1, [1])
    s2, o2 = state.fold(s1, snap(spark, a, (2, "b", 6, "observed")), 2, [1])
    s3, o3 = state.fold(s2, snap(spark, a), 3, [1])
    s4, o4 = state.fold(s3, snap(spark, a, b), 4, [1])
    assert kinds(o1) == {1: "first_seen", 2: "first_seen"} and kinds(o2) == {2: "modified"} and kinds(o3) == {} and kinds(o4) == {2: "reappeared"}
    assert states(s3) == {1: "present", 2: "missing"} and states(s4) == {1: "present", 2: "present"}


def test_unreachable_root_marks_nothing_missing(spark):
    s1, _ = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "a", 5, "observed")), 1, [1])
    s2, o2 = state.fold(s1, snap(spark), 2, [])
    assert states(s2) == {1: "present"} and o2.count() == 0


def test_q3_unreadable_twice_stays_unreadable(spark):
    s, _ = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "a", 5, "observed")), 1, [1])
    s, o = state.fold(s, snap(spark, (1, "a", 5, "inaccessible")), 2, [1])
    assert kinds(o) == {1: "inaccessible"}
    s, o = state.fold(s, snap(spark, (1, "a", 5, "inaccessible")), 3, [1])
    assert kinds(o) == {} and states(s) == {1: "inaccessible"}


def test_q5_unlistable_folder_hides_nothing(spark):
    s, _ = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "Locked\\a", 5, "observed"), (2, "b", 5, "observed")), 1, [1])
    s, _ = state.fold(s, snap(spark), 2, [1], unlistable=["locked"])
    assert states(s) == {1: "present", 2: "missing"}


def test_state_rows_do_not_grow_with_runs(spark):
    files = [(i, f"f{i}", i, "observed") for i in range(30)]
    s, log = spark.createDataFrame([], state.STATE), 0
    for run in range(1, 5):
        s, o = state.fold(s, snap(spark, *files), run, [1])
        log += o.count()
    assert s.count() == 30 and log == 30


def test_reclaimable_is_unknown_without_every_identity(spark):
    rows = [(1, 1, "present", "S", 7, "1", "a", 1, 1), (2, 1, "present", "S", 7, "1", "a", 1, 1), (3, 2, "present", "S", 7, None, None, 1, 1), (4, 1, "present", "X", 3, "1", "b", 2, 1)]
    df = spark.createDataFrame(rows, "file_id long, root_id int, state string, sha256 string, size_bytes long, volume_serial string, file_index string, current_observation_id long, content_observation_id long")
    (r,) = current_sets(df).collect()
    assert r["location_count"] == 3 and r["reclaimable_bytes"] is None and not r["physical_identity_complete"]
    (r,) = current_sets(df.where("file_id < 3")).collect()
    assert r["hard_link_alias_count"] == 1 and r["reclaimable_bytes"] == 0
