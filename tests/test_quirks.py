"""Decisions on known quirks: what the engine does instead."""

import random

from pyspark.sql import functions as F
from test_state import kinds, snap, states

from stratafile.operators import analyzers, hashing, ingest, state
from stratafile.sources import corpus
from test_rules import hash_rows

ENTRY = "array<struct<path:string,size:long,compressed:long>>"


def archives(spark):
    return spark.createDataFrame([(1, [("a/x.txt", 10, 4), ("A/X.txt", 9, 9), ("b.md", 5, 5)]), (2, [])], f"archive_id long, entries {ENTRY}")


def test_q1_archive_members_persist_through_the_sink(spark):
    sink = ingest.ResultSink(spark, "archive_id long, sequence int, entry_path string", "members")
    members = analyzers.archive_members(archives(spark)).select("archive_id", "sequence", "entry_path")
    sink.add(0, members.where("archive_id = 1"))
    sink.add(1, members.where("archive_id = 2"))
    assert sorted(tuple(r) for r in sink.read().collect()) == [(1, 1, "a/x.txt"), (1, 3, "b.md")]


def test_q2_summaries_and_extractions_are_whole(spark):
    rows = {r["archive_id"]: r for r in analyzers.archive_summary(archives(spark), cap=2).collect()}
    assert (rows[1]["entries"], rows[1]["bytes"], rows[1]["mode"], rows[1]["truncated"]) == (3, 24, "capped", True) and rows[2]["mode"] == "complete"
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], "file_id long, text string")
    found = {r["file_id"]: (r["text_sha256"] is not None, r["status"], r["reused"]) for r in analyzers.extraction(texts, [F.col("file_id")]).collect()}
    assert found == {1: (True, "extracted", False), 2: (True, "extracted", True), 3: (False, "empty", False)}


def test_q4_a_later_root_leaves_the_earlier_one_alone(spark):
    s1, _ = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "a", 5, "observed"), (2, "b", 5, "observed")), 1, [1])
    other = snap(spark, (7, "z", 5, "observed")).withColumn("root_id", F.lit(2))
    s2, o2 = state.fold(s1, other, 2, [2])
    assert states(s2) == {1: "present", 2: "present", 7: "present"} and kinds(o2) == {7: "first_seen"}


def test_q6_vanishing_is_state_alone(spark):
    s1, _ = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "a", 5, "observed")), 1, [1])
    s2, o2 = state.fold(s1, snap(spark), 2, [1])
    row = s2.first()
    assert (row["state"], row["state_changed_run_id"]) == ("missing", 2) and o2.count() == 0
    s3, o3 = state.fold(s2, snap(spark), 3, [1])
    assert s3.first()["state_changed_run_id"] == 2 and o3.count() == 0


def test_q7_unchanged_files_stay_in_the_inventory_of_a_repeat_run(spark):
    s1, o1 = state.fold(spark.createDataFrame([], state.STATE), snap(spark, (1, "a", 5, "observed"), (2, "b", 5, "observed")), 1, [1])
    s2, o2 = state.fold(s1, snap(spark, (1, "a", 5, "observed"), (2, "b", 9, "observed")), 2, [1])
    assert kinds(o2) == {2: "modified"}
    seen = {r["file_id"]: (r["current_run_id"], r["current_observation_id"] // state.RUN_SPAN) for r in s2.where("state = 'present'").collect()}
    assert seen == {1: (2, 1), 2: (2, 2)}


def test_results_do_not_depend_on_order_or_partitions(spark):
    random.seed(12)
    texts = ["".join(random.choice("ab") for _ in range(random.choice([0, 2, 9, 12]))) for _ in range(50)]
    rows = hash_rows(spark, texts)
    ladder = lambda df: sorted(map(str, (tuple(r) for r in hashing.selective(hashing.entries(df), 8).collect())))
    whole = lambda df: sorted(map(str, (tuple(r) for r in hashing.exhaustive(hashing.entries(df)).collect())))
    shuffled = spark.createDataFrame(random.sample(rows.collect(), 50), rows.schema).repartition(6)
    assert ladder(rows.coalesce(1)) == ladder(shuffled) and whole(rows.coalesce(1)) == whole(shuffled)


def test_one_state_row_for_each_location_however_many_runs(spark):
    now = spark.createDataFrame([], state.STATE)
    for run in range(1, 5):
        now, _ = state.fold(now, snap(spark, (1, "a", run, "observed"), (2, "b", 5, "observed")), run, [1])
    assert now.count() == 2 and len(corpus.ROOTS) == 4
