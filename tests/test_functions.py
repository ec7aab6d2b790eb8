"""Expressions against their plain-Python meaning."""

import random

from pyspark.sql import functions as F

from stratafile.functions import attrs, paths, render, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_extensions(spark):
    cases = {".gitignore": (".gitignore", ""), "trailing.": ("", ""), "REPORT.PDF": (".PDF", ".pdf"), "plain": ("", ""), "a.tar.gz": (".gz", ".gz"), "..a": (".a", ".a")}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert {r[0]: (r[1], r[2]) for r in df.select("n", paths.extension(F.col("n")), paths.suffix(F.col("n"))).collect()} == cases


def test_word_and_line_counts(spark):
    random.seed(4)
    letters = ["a", "ß", " ", "\n", "\r", " ", "\x85", "\x0b", "\x0c", "\x1c", "\x1d", "\t", "\xa0", "　", "😊"]
    samples = ["", "\r\n", "a\r\nb\n", "\x85"] + ["".join(random.choice(letters) for _ in range(random.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", text.word_count(F.col("s")).alias("w"), text.line_count(F.col("s")).alias("n")).collect():
        assert (r["w"], r["n"]) == (len(r["s"].split()), len(r["s"].splitlines())), repr(r["s"])


def test_attribute_words(spark):
    cases = {0: "0", 1: "ReadOnly", 33: "ReadOnly, Archive", 34: "Hidden, Archive", 4128: "Archive, Offline", 0x400000: "4194304", 0x80000: "524288"}
    df = spark.createDataFrame([(w,) for w in cases], "w long")
    assert {r[0]: r[1] for r in df.select("w", attrs.names(F.col("w"))).collect()} == cases


def test_times(spark):
    assert one(spark, render.iso_from_ns(F.lit(1755200776000000000))) == "2025-08-14T19:46:16Z"
    assert one(spark, render.iso_from_ns(F.lit(-1))) == "1969-12-31T23:59:59Z"
    assert one(spark, render.estimate_text(F.lit(59))) == "under a minute"
    assert one(spark, render.estimate_text(F.lit(3600))) == "~1 hr" and one(spark, render.estimate_text(F.lit(3700))) == "~1 hr 2 min"
    assert one(spark, render.clock(F.lit(3725))) == "01:02:05"


def test_sizes(spark):
    assert one(spark, render.human_bytes(F.lit(1536).cast("long"))) == "1.50 KB" and one(spark, render.human_bytes(F.lit(1023).cast("long"))) == "1,023.00 B"


def test_long_paths(spark):
    assert one(spark, paths.long_path(F.lit("\\\\srv\\x"))) == "\\\\?\\UNC\\srv\\x"
    assert one(spark, paths.short_path(F.lit("\\\\?\\UNC\\srv\\x"))) == "\\\\srv\\x" and one(spark, paths.short_path(F.lit("\\\\?\\C:\\x"))) == "C:\\x"
    assert one(spark, paths.utf16_length(F.lit("a😊"))) == 3
