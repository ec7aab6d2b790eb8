"""Helpers that several training-data operators use: ranks, components; tables come from ``sources.store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources.store import BROADCAST_ROWS, Table, few, new_path, remove, when_small, written

__all__ = ["BROADCAST_ROWS", "Table", "components", "join_popular", "few", "new_path", "rank_within", "remove", "same", "when_small", "written"]

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+`` (fixed values).
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rank_within(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... without gaps inside every group, whatever the group's size; equal rows get ranks of their own.

    Rows are dealt over ranges of their order, equal ones by where they were
    read, so neither a group nor repeated rows meet in one task.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = ranking.ranked(tied, "__rank", group, [*[F.col(c) for c in order], F.col("__tie")])
    return rows.select(*df.columns, (F.col("__rank") - 1).alias(rank))


#: A key with more rows than this is popular: its rows meet their partner by a broadcast, where they are.
POPULAR = 10_000


def join_popular(rows: DataFrame, facts: DataFrame, keys: list[tuple[str, str]], copies: str, nulls: bool = True) -> DataFrame:
    """``rows`` left join ``facts`` on the (row, fact) columns of ``keys``; no key that has many rows meets in one task.

    ``facts``, a written table, has one row for a key and in ``copies`` how many
    of ``rows`` have that key, so popular ones are few. A null key has no
    partner; without ``nulls`` there is none.
    """
    on = [F.col(a) == F.col(b) for a, b in keys]
    known = F.lit(True)
    for a, _ in keys:
        known = known & F.col(a).isNotNull()
    met = rows.where(known) if nulls else rows
    heavy = facts.where(F.col(copies) > POPULAR)
    if heavy.isEmpty():
        out = met.join(facts, on, "left")
    else:
        heavy = when_small(heavy)
        seldom = met.join(heavy.select(*[b for _, b in keys]), on, "left_anti").join(facts.where(F.col(copies) <= POPULAR), on, "left")
        out = met.join(heavy, on).unionByName(seldom)
    if not nulls:
        return out
    return out.unionByName(rows.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields]))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Each round every node moves to the neighbour with the lowest hash (its own
    included) and edges are rewritten to where their ends went; the graph at
    least shrinks by a constant factor in expectation, so rounds grow with the
    logarithm of its diameter. Only counts reach the driver. A hub is a join
    key with many rows on one side, which adaptive execution splits.
    Nodes are longs; edges with a null end or equal ends are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    table = Table(pairs, "edges")
    moves: list[Table] = []
    turn = 0
    while not table.df.isEmpty():
        turn += 1
        both = table.df.unionByName(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("to"))  # noqa: B023, E731
        low = both.groupBy("u").agg(F.min(draw(F.col("v"))).alias("low"))
        move = low.select(F.col("u").alias("node"), F.least(F.col("low"), draw(F.col("u")))["to"].alias("to"))
        moves.append(Table(move, f"moves{turn}"))
        left = moves[-1].df.select(F.col("node").alias("u"), F.col("to").alias("p"))
        right = moves[-1].df.select(F.col("node").alias("v"), F.col("to").alias("q"))
        moved = table.df.join(left, "u").join(right, "v").where("p <> q")
        fresh = Table(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "edges")
        table.drop()
        table = fresh
    spark = edges.sparkSession
    if not moves:
        return spark.createDataFrame([], "node long, component long")
    # from the last round back: where a node went, and where that went later
    later = None
    for step in reversed(moves):
        if later is None:
            later = step.df
        else:
            ahead = later.select(F.col("node").alias("to"), F.col("to").alias("end"))
            later = step.df.join(ahead, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    roots = Table(later, "roots")
    for step in moves:
        step.drop()
    table.drop()
    least = roots.df.groupBy("to").agg(F.min("node").alias("component"))
    # the root itself is a node of the first round, so the smallest node of a root is the smallest of its component
    return roots.df.join(least, "to").select("node", "component")
