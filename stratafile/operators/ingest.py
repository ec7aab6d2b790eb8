"""Appending and replacing rows of stored tables, each key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path
from .ranking import first_of


def append_new(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` and the rows of ``fresh`` whose key it hasn't, each once."""
    new = fresh.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def replace_keys(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` without the keys that ``fresh`` has, and ``fresh``: ingesting a batch again changes nothing."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def insert_or_ignore(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row that came first for each key."""
    return first_of(rows, key, order)


def open_run(runs: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The one run that counts for each key: a later one takes the place of those before it."""
    return first_of(runs, key, [order], last=True)


def flag_value(raw: Column) -> Column:
    """Flags as they are compared: 1, true and yes, 0, false and no whatever their case, null for anything else."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False)


def with_parents(children: DataFrame, parents: DataFrame, key: str, take: list[str]) -> DataFrame:
    """Children with columns of their parent; one without a parent is left out."""
    return children.join(parents.select(key, *take), key)


def stage_outcome(errors: Column, fatal: bool = True) -> Column:
    """Aggregate: the status of an ingest stage from its count of errors; a non-fatal one only warns."""
    return F.when(errors > 0, "failed" if fatal else "completed_with_warnings").otherwise("completed")


class ResultSink:
    """A result table written in batches as results come: each batch is whole or absent, and a retry writes it once.

    A batch goes into a folder of its own, named by its number, and is listed
    only after it is complete; :meth:`read` sees listed batches alone.
    """

    def __init__(self, spark: SparkSession, schema: str, name: str = "results"):
        self.spark, self.schema = spark, schema
        self.path = new_path(spark, name)
        self.batches: dict[int, str] = {}

    def add(self, batch: int, rows: DataFrame) -> bool:
        """Writes a batch; one that was written before is left as it is."""
        if batch in self.batches:
            return False
        part = f"{self.path}/batch={batch}"
        rows.write.mode("overwrite").parquet(part)
        self.batches[batch] = part
        return True

    def read(self) -> DataFrame:
        parts = [self.batches[k] for k in sorted(self.batches)]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
