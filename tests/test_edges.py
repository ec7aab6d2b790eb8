"""Queries against their SQL on rows at limits and with nulls, which the test tables don't have."""

import datetime

import compare
from pyspark.sql import functions as F

from stratafile.functions import render
from stratafile.plans import catalog


def same(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    compare.same(spark, name, catalog.QUERIES[name], catalog.SQL[name], str(tmp_path))


def test_fixed_digits_are_those_of_c(spark):
    values = [100.0 * (1 - c / b) for b in range(1, 1200, 7) for c in range(b // 2 - 3, b // 2 + 4)] + [k / 20 for k in range(-200, 2200)] + [k / 8 for k in range(-20, 20)] + [0.0, -0.0, -0.04, 99.95]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", render.fixed(F.col("v"), 1).alias("x")).collect()
    assert [(r["v"], r["x"]) for r in found if r["x"] != f"{r['v']:.1f}"] == []


def test_archive_ratios_at_halves_and_unknown_sizes(spark, tmp_path):
    turns = [(1, "a" * 999), (1, "b" * 1001), (2, "a" * 3999), (2, "b"), (3, "a" * 199), (3, "b"), (4, None), (4, None), (5, None), (5, "a"), (6, ""), (None, "abc"), (None, None), (7, "é😊"), (8, "x"), (8, "x"), (8, "x"), (8, "x")]
    same(spark, tmp_path, "a26_archive_summary", "conversations", [(c, i, "user", t) for i, (c, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_stale_runs_a_microsecond_from_the_limit(spark, tmp_path):
    now = datetime.datetime(2024, 3, 1, 12, 0, 0, 250_000)
    ages = {1: 180.0, 2: 180.000001, 3: 179.999999, 4: 180.2, 6: 180.9, 8: 181.0, 11: 0.0, 12: None, 14: None, 35: None, 5: None, 7: 0.5, 10: 1.0, -4: 180.3}
    rows = [(i, age if age is None else now - datetime.timedelta(seconds=age), k) for i, (k, age) in enumerate(ages.items())] + [(90, now, None), (91, None, None)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    same(spark, tmp_path, "i5s_stale_runs", "events", [(*r, "view", 1.0, "{}") for r in rows], schema)
    found = {r["run_id"] for r in catalog.QUERIES["i5s_stale_runs"](spark, str(tmp_path)).collect()}
    assert found == {2, 4, 6, 8, 11, 12, 5, 10, -4}
