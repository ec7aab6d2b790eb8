"""Dense numbers and ranks without a sort of everything, or of one large group, in one task.

Rows are dealt over ranges of their order and written once; a row's number is
its place in its range plus the counts of the ranges before it. The driver
sees one count for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Table

#: ``monotonically_increasing_id`` gives the partition above this bit and the place in it below.
PLACE_BITS = 33


def _ranged(df: DataFrame, order: list[Column]) -> Table:
    """``df`` in ranges of ``order``, with ``__range`` and the place inside it as ``__place``."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return Table(rows.select("*", F.shiftright(at, PLACE_BITS).cast("int").alias("__range"), at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__place")), "ranged")


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order``, which must leave no ties."""
    rows = _ranged(df, order).df
    counts = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # one row for each range
    shifts, seen = [], 0
    for k in range(max(counts, default=-1) + 1):
        shifts.append(seen)
        seen += counts.get(k, 0)
    shift = F.get(F.array(*[F.lit(x).cast("long") for x in shifts or [0]]), F.col("__range"))
    return rows.select(*df.columns, (shift + F.col("__place") + 1).alias(name))


def ranked(df: DataFrame, name: str, by: list[str], order: list[Column], size: str | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order`` inside each group of ``by``, and ``size``, the rows of the group.

    A large group lies in several ranges, so it is neither sorted nor joined in
    one task. ``order`` must leave no ties inside a group.
    """
    rows = _ranged(df, [*[F.col(c) for c in by], *order]).df
    keys = [*by, "__range"]
    parts = rows.groupBy(*keys).agg(F.min("__place").alias("__start"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start", before.alias("__before"), F.sum("__n").over(whole).alias("__all"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    place = (F.col("__place") - F.col("__start") + F.col("__before") + 1).cast("long")
    extra = [F.col("__all").alias(size)] if size else []
    return rows.join(parts, on).select(*df.columns, place.alias(name), *extra)


def first_of(df: DataFrame, by: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or ``last``) row of each group, by partial aggregation: a group of any size sends one row a task."""
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*by).agg(pick(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__row"))
    return best.select("__row.*")
