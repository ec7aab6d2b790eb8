"""Semantics with spelt-out values: status orders, liveness, logs, Markdown, the registry, the content store, reports, clocks."""

import datetime
import hashlib
import os
import random
import re

from pyspark.sql import functions as F

from stratafile.functions import text, times
from stratafile.operators import analyzers, exports, hashing, ingest, ledger, lifecycle, reports
from stratafile.operators.ranking import numbered, ranked
from stratafile.sources import logs

T0 = datetime.datetime(2024, 1, 1)


def test_worst_root_status(spark):
    cases = {("skipped", "completed"): "skipped", ("failed", "skipped"): "failed", ("completed", "completed_with_warnings"): "completed_with_warnings", ("failed", "strange"): "strange", (None, "completed"): "completed", (None,): None}
    df = spark.createDataFrame([(i, s) for i, c in enumerate(cases) for s in c], "k int, s string")
    found = {r["k"]: r["w"] for r in df.groupBy("k").agg(ledger.worst(F.col("s")).alias("w")).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_run_status(spark):
    cases = [
        ([("a", "completed"), ("b", "interrupted"), ("c", "paused")], "interrupted"), ([("a", "paused"), ("b", "failed")], "paused"), ([("a", "failed"), ("b", "completed")], "failed"),
        ([("inventory_ingest", "failed"), ("b", "completed")], "completed_with_warnings"), ([("inventory_ingest", "failed"), ("b", "failed")], "failed"), ([("a", "completed_with_warnings")], "completed_with_warnings"), ([("a", "skipped"), ("b", None)], "completed"),
    ]
    df = spark.createDataFrame([(i, k, s) for i, (c, _) in enumerate(cases) for k, s in c], "i int, k string, s string")
    found = {r["i"]: (r["x"], r["y"]) for r in df.groupBy("i").agg(ledger.run_status(F.col("s"), F.col("k")).alias("x"), ledger.run_status(F.col("s"), F.col("k"), tolerant=True).alias("y")).collect()}
    assert [found[i][0] for i in range(len(cases))] == [w for _, w in cases]
    assert found[2][1] == found[4][1] == "completed_with_warnings" and found[0][1] == "interrupted"


def test_runs_never_heard_are_stale(spark):
    now = T0 + datetime.timedelta(hours=1)
    rows = [(1, None, None, None), (2, now, None, None), (3, now, False, None), (4, T0, True, None), (5, None, None, now), (6, None, None, None)]
    df = spark.createDataFrame([(i, h, a, None, s) for i, h, a, s in rows], "run_id int, heartbeat timestamp, alive boolean, ended timestamp, started timestamp")
    found = {r["run_id"]: r["reason"] for r in ledger.stale_runs(df, F.lit(now)).collect()}
    assert found == {1: "heartbeat_expired", 3: "process_gone", 4: "heartbeat_expired", 6: "heartbeat_expired"}


def test_console_lines(spark):
    cases = {"error: x": "error", "  Fatal y": "error", "CRITICAL:": "error", "Warning: y": "warning", "warn\tz": "warning", "ERRORS abound": None, "no error: here": None, "Traceback (most recent call last):": "error"}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", logs.console_severity(F.col("x"))).collect()} == cases


def test_error_file(spark, tmp_path):
    lines = ["\ufeffFILE ERROR: C:\\a -- denied -- twice", "", "DIRECTORY ACCESS ERROR:C:\\b  --  no list", "OTHER ERROR: c -- d", "   ", "plain", "FILE ERROR: C:\\e -- x"]
    path = tmp_path / "errors.txt"
    path.write_text("\n".join(lines), encoding="utf-8")
    found = sorted(logs.read_errors(spark, str(path), cap=4).collect(), key=lambda r: r["line_no"])
    assert [(r["error_type"], r["file_path"], r["message"]) for r in found[:4]] == [("FILE ERROR", "C:\\a", "denied -- twice"), ("DIRECTORY ACCESS ERROR", "C:\\b", "no list"), (None, None, "OTHER ERROR: c -- d"), (None, None, "plain")]
    assert [r["severity"] for r in found] == ["warning"] * 4 + ["info"] and found[0]["file_skipped"] and found[2]["file_skipped"] is None and len(found) == 5
    assert logs.read_errors(spark, str(path)).count() == 5


def markdown(s):
    """What each field means, in plain Python."""
    title, front = "", s.startswith("---")
    end = s.find("\n---", 3) if front else -1
    if end >= 0 and (m := re.search(r"(?m)^title:\s*(.+)$", s[3:end])):
        title = m[1].strip().strip('"').strip("'")
    if not title and (m := re.search(r"(?m)^#\s+(.+)$", s)):
        title = m[1].strip()
    is_head = [bool(re.match(r"#{1,6}\s", x.lstrip() + " ")) and bool(re.match(r"#{1,6}\s+", x.lstrip())) for x in s.splitlines()]
    tags = sum(len(re.findall(r"#[A-Za-z]", x)) for x, h in zip(s.splitlines(), is_head, strict=True) if not h)
    return (title or None, sum(is_head), len(re.findall(r"\[\[.*?\]\]", s)), tags, front)


def test_markdown_against_model(spark):
    random.seed(8)
    bits = ["# ", "## ", "#", "#a", " #b", "\n", "\r\n", "  ", "\t", "x", "---\n", "\n---", "title: ", '"q"', "[[p]]", "[[", "]]", "\x0b", "\x1c", "\xa0", "\u2028", "é", "####### ", "'"]
    cases = ["#a #a\n  ## H", "---\ntitle: 'x'\n---\n# y", "---\ntitle: \n---\n# y", "# T", "#  \n# z", ""] + ["".join(random.choice(bits) for _ in range(random.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(s,) for s in cases], "text string")
    for r in analyzers.text_stats(df).collect():
        assert (r["title"], r["headings"], r["wiki_links"], r["tags"], r["front_matter"]) == markdown(r["text"]), repr(r["text"])


def test_registry_values():
    by = {a.key: a for a in analyzers.REGISTRY}
    assert [a.key for a in analyzers.REGISTRY] == ["image", "pdf", "office", "raw_image", "audio", "video", "text", "archive", "content_extraction"]
    assert {".raw", ".rwl", ".srw"} <= set(by["raw_image"].suffixes) and not {".crw", ".ptx", ".dcr", ".mef"} & set(by["raw_image"].suffixes) and len(by["raw_image"].suffixes) == 21
    assert ".3gp" in by["video"].suffixes and ".ts" not in by["video"].suffixes and by["image"].excluded == by["raw_image"].suffixes


def test_content_store_keeps_what_it_has(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "")], "file_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    path = lambda s: f"{sha(s)[:2]}/{sha(s)[2:4]}/{sha(s)}.txt"
    first = {r["file_id"]: (r["storage"], r["reused"]) for r in exports.store_texts(df, folder).collect()}
    assert first == {1: (path("one"), False), 2: (path("two"), False), 3: (path("one"), True), 5: (path(""), False)}
    target = tmp_path / "store" / path("one")
    assert target.read_text() == "one"
    os.utime(target, (1, 1))
    more = spark.createDataFrame([(1, "one"), (9, "nine")], "file_id long, text string")
    again = {r["file_id"]: r["reused"] for r in exports.store_texts(more, folder).collect()}
    assert again == {1: True, 9: False} and target.stat().st_mtime == 1 and (tmp_path / "store" / path("two")).exists()
    assert not [x for _, _, names in os.walk(tmp_path) for x in names if x.endswith(".partial")]


def test_stage_scopes():
    assert exports.stage_artifacts("hash") == ["potential_duplicates", "partial_hash_candidates", "full_hash_inventory", "duplicate_hash_inventory"]
    assert exports.stage_artifacts("archive") == ["archive", "archive_contents"] and exports.stage_artifacts("content_extraction") == ["content_index"] and len(exports.stage_artifacts("all")) == 17


def test_numbers_do_not_depend_on_partitions(spark):
    random.seed(5)
    rows = [(random.choice("aaaaaaab"), i) for i in range(300)]
    want = {i: k for k, (_, i) in enumerate(sorted(rows), 1)}
    for parts in (1, 7):
        df = spark.createDataFrame(random.sample(rows, 300), "g string, i int").repartition(parts)
        assert {r["i"]: r["n"] for r in numbered(df, "n", [F.col("g"), F.col("i")]).collect()} == want
        found = {r["i"]: (r["n"], r["s"]) for r in ranked(df, "n", ["g"], [F.desc("i")], size="s").collect()}
        for g in "ab":
            own = sorted((i for x, i in rows if x == g), reverse=True)
            assert [found[i] for i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    empty = spark.createDataFrame([], "g string, i int")
    assert numbered(empty, "n", [F.col("i")]).count() == 0 and ranked(empty, "n", ["g"], [F.col("i")]).count() == 0


SCHEMA = "file_id long, root_id int, relative_path string, attribute_word long, volume_serial string, file_index string, minutes long, inaccessible boolean, text string"


def hash_rows(spark, texts):
    return spark.createDataFrame([(i, 1, f"f{i:03}", 32, None, None, 0, False, t) for i, t in enumerate(texts)], SCHEMA)


def test_no_exchange_carries_a_body(spark, monkeypatch):
    """Every stage of the ladder is planned with broadcasts by size switched off; bodies still stay where they are."""
    plans = []
    real = hashing.Table

    class Watched(real):
        def __init__(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            super().__init__(df, name)

    monkeypatch.setattr(hashing, "Table", Watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = hashing.entries(hash_rows(spark, ["aaaa", "bbbb", "12345678-tail1", "12345678-tail2", "12345678-tail1"]))
        for bound in (10, 0):
            monkeypatch.setattr(hashing, "few", lambda df, rows=bound: rows > 0)
            out = hashing.selective(e, 8)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 8 and any("sha2" in p for p in plans)
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange" in line and "BroadcastExchange" not in line:
                below = next(x for x in lines[i + 1 :] if x.strip())
                assert not re.search(r"\btext#", below.partition("Scan")[0]), below
            assert "SinglePartition" not in line, line


def report_input(spark, texts):
    e = hashing.entries(hash_rows(spark, texts))
    r = hashing.selective(e, 8)
    f = e.select("file_id", "relative_path", "cloud", F.col("file_id").alias("place"), F.lit(".txt").alias("extension"), F.lit("Archive").alias("attributes"), F.lit(0).alias("depth"), F.lit(10).alias("path_length"))
    return r.join(f, "file_id")


NAMES = {"project": "P", "run": "r", "generated": "now"}


def test_reports(spark):
    r = report_input(spark, ["solo", "aaaaa", "bbbbb", "12345678-tail1", "12345678-tail2", "12345678-tail1", "cc", "cc"]).cache()
    one = reports.size_report(r, **NAMES)
    assert "  Files with a size-match (kept)   : 7 (87.5% of files, 93.3% of bytes)" in one and "  Group   1 | 3 files x 14.00 B = up to 28.00 B reclaimable" in one and "      - f003" in one
    two = reports.partial_report(r, window=8, **NAMES)
    assert "  Confirmed duplicates (fully hashed): 2 files, 1 groups, 2.00 B reclaimable" in two and "  Still needs full hash (Script 4)   : 3 files, 1 groups, up to 28.00 B reclaimable" in two
    assert not any("Skipped" in x for x in two)
    three = reports.final_report(r, whole=False, before=(9, 60), **NAMES)
    assert "  File count difference : -1" in three and "  UniqueBySize            : 1" in three
    assert "  Group   2 | 2 files x 14.00 B = 14.00 B reclaimable  [confirmed via: FullHash]" in three
    four = reports.final_report(r.where("file_id < 1"), whole=True, **NAMES)
    assert "  (none)" in four and "  Confirmed duplicate groups : 0" in four
    empty = r.where("false")
    assert "  (none)" in reports.size_report(empty, **NAMES) and "  (none)" in reports.partial_report(empty, **NAMES) and "  (none)" in reports.final_report(empty, whole=False, **NAMES)
    lines = spark.createDataFrame([(x,) for x in two], "x string")
    assert lines.where(reports.is_volatile(F.col("x"))).count() == 5


def test_life_cycle(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    base = spark.range(1)
    parts = [
        lifecycle.change("create", F.lit(1), at(0)), lifecycle.change("create", F.lit(1), at(1), F.lit(1), F.lit("scan")), lifecycle.change("finish", F.lit(1), at(3), F.lit(1), F.lit("scan"), F.lit("failed")),
        lifecycle.change("skip", F.lit(1), at(4), F.lit(2), F.lit("hash")), lifecycle.change("create", F.lit(1), at(5), F.lit(3), F.lit("late")), lifecycle.change("finish", F.lit(1), at(2), F.lit(3), F.lit("late")),
    ]
    log = None
    for p in parts:
        log = base.select(*p) if log is None else log.unionByName(base.select(*p))
    found = {r["sequence"]: (r["status"], r["duration_ms"]) for r in lifecycle.current(log).collect()}
    assert found == {0: ("running", None), 1: ("failed", 2000), 2: ("skipped", None), 3: ("running", None)}
    r = lifecycle.runs(log).first()
    assert (r["stage_count"], r["failed_stages"], r["status"]) == (3, 1, "running")
    closed = log.unionByName(lifecycle.interrupted(log, spark.createDataFrame([(1, "gone")], "run_id long, reason string"), at(9)))
    assert {r["sequence"]: r["status"] for r in lifecycle.current(closed).collect()} == {0: "interrupted", 1: "failed", 2: "skipped", 3: "interrupted"}


def test_result_sink_writes_a_batch_once(spark):
    sink = ingest.ResultSink(spark, "k long")
    assert sink.read().count() == 0
    assert sink.add(0, spark.range(3).withColumnRenamed("id", "k")) and sink.add(1, spark.range(2).withColumnRenamed("id", "k")) and not sink.add(0, spark.range(9).withColumnRenamed("id", "k"))
    assert sink.read().count() == 5


def test_clocks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    ns = 1_720_000_000 * 10**9
    assert one(times.local_clock(F.lit(ns), "America/New_York")) == "2024-07-03T05:46:40" and one(times.offset_minutes(F.lit(ns), "America/New_York")) == -240
    zero = F.lit("-11644473600000000000").cast("decimal(20,0)")
    assert one(times.offset_minutes(zero, "UTC")) is None and one(times.local_clock(zero, "UTC")) == "0001-01-01T00:00:00"
    for s, want in {"2024-01-01T00:00:00Z": 1704067200, "2024-01-01T00:00:00.250000+00:00": 1704067200, "2024-01-01 01:00:00+01:00": 1704067200, "2024-01-01": 1704067200, "": None, "soon": None}.items():
        assert one(F.unix_seconds(times.utc_or_null(F.lit(s)))) == want, s
    assert one(times.script_version(F.lit("# x\n  Version: 1.2.3 b\n"))) == "1.2.3" and one(times.script_version(F.lit("none"))) is None
    assert one(times.log_line(F.lit(T0), F.lit("warning"), F.lit("scan"), F.lit("a\n b"))) == "2024-01-01T00:00:00.000Z  WARNING  [scan]                     a b"
    assert str(one(times.share_of_drive(F.lit(1), F.lit(3)))) == "33.33" and one(times.share_of_drive(F.lit(1), F.lit(0))) is None


def test_batches_ingested_again(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ingest.append_new(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "w")]
    once = ingest.replace_keys(a, b.distinct(), ["k"])
    assert rows(once) == rows(ingest.replace_keys(once, b.distinct(), ["k"])) == [(1, "x"), (2, "z"), (3, "w")]
    flags = spark.createDataFrame([("1",), (" YES",), ("no",), ("2",), (None,)], "f string")
    assert [r[0] for r in flags.select(ingest.flag_value(F.col("f"))).collect()] == [True, True, False, None, None]
