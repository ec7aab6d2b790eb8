"""The three-run history of the test corpus, folded step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hashing, state
from ..sources import corpus
from ..sources.store import once


def _later(rows: DataFrame) -> DataFrame:
    edited = F.col("minutes") % 11 == 0
    return rows.withColumn("text", F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("moved", F.when(edited, 60).otherwise(0))


def snapshot(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """Corpus rows with their bodies as run 1, 2 or 3 finds them."""
    rows = corpus.raw(spark, sf_dir, (1,) if run == 3 else (1, 2))
    if run == 1:
        return rows.where("minutes % 17 <> 0").withColumn("moved", F.lit(0))
    rows = _later(rows)
    return rows.where("minutes % 19 <> 0") if run == 2 else rows


def records(rows: DataFrame) -> DataFrame:
    return corpus.described(rows.withColumn("minutes", F.col("minutes") + F.col("moved")))


def digests(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("inaccessible")).select("file_id", hashing.digest(F.col("text")).alias("sha256"))


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], state.STATE)


def after(spark: SparkSession, sf_dir: str, run: int) -> tuple[DataFrame, DataFrame]:
    """(state, all observations) after the given run, as it stored them. Digests are taken in runs 1 and 3 only.

    A run reads the state that the run before it stored, so no body is read
    twice, and queries on state read no body at all.
    """
    log = None
    for k in range(1, run + 1):
        seen = once(spark, ("observations", sf_dir, k), lambda k=k: _folded(spark, sf_dir, k)[1])
        log = seen if log is None else log.unionByName(seen)
    return stored(spark, sf_dir, run), log


def stored(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """The state that a run stored."""
    if run == 0:
        return nothing(spark)

    def build():
        now = _folded(spark, sf_dir, run)[0]
        return now if run == 2 else state.promote(now, digests(snapshot(spark, sf_dir, run)), run)

    return once(spark, ("state", sf_dir, run), build)


def _folded(spark: SparkSession, sf_dir: str, run: int) -> tuple[DataFrame, DataFrame]:
    return state.fold(stored(spark, sf_dir, run - 1), records(snapshot(spark, sf_dir, run)), run, [1] if run == 3 else [1, 2])
