"""Tables written to the shared folder: what must outlive a job, and be computed once.

The folder is ``spark.checkpoint.dir`` of the session, which the driver and
all executors see, so a lost executor never takes an intermediate result with
it. Only in local mode without that setting a temporary folder stands in.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []

#: Rows of one or two numbers that may be broadcast: about 16 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode without a setting."""
    global _LOCAL_FALLBACK
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_FALLBACK is None:
        _LOCAL_FALLBACK = "file://" + tempfile.mkdtemp(prefix="stratafile-")
    return _LOCAL_FALLBACK


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/stratafile/{uuid.uuid4().hex}-{name}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`new_path` gave, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            return


atexit.register(_sweep)


class Table:
    """A DataFrame written once to the shared folder and read from there: cut lineage, no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        if (self.spark, self.path) in _WRITTEN:
            _WRITTEN.remove((self.spark, self.path))


def written(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


_ONCE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """The stored table of ``key``, written by the first call of the session: what a scan leaves behind and queries read."""
    name = (spark.sparkContext.applicationId, *key)
    if name not in _ONCE:
        _ONCE[name] = written(build(), str(key[0]))
    return _ONCE[name]


def filesystem(uri: str):
    """(file system, path) of a folder that all executors see."""
    import pyarrow.fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, best a written table, has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def when_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it was counted to be within ``rows``; else as it is, for a shuffled join."""
    table = written(df, "side")
    return F.broadcast(table) if few(table, rows) else table
