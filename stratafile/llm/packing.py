"""Best-fit packing planned on the histogram of lengths.

1. ``pieces(df)`` tokenizes whole texts and cuts only what is longer than a
   sequence; the piece's token ids stay in ``ids``.
2. ``plan(histogram, capacity)`` runs best-fit decreasing over counts: bins with
   the same history are one interval, so the plan has a size that depends on
   the capacity alone, not on the corpus.
3. ``assign(pieces)`` ranks the pieces within each length and gives rank r of
   length L the planned slot r of L.

Null texts count as empty: one piece with the separator alone. Equal rows each
get a slot of their own.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._shared import Table, rank_within

CAPACITY = 1024
SEPARATOR = 2


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every row's text and the separator after it.

    Longer texts are cut from the end: every piece but the first holds exactly
    ``capacity`` tokens.
    """
    out = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        out = out.add("ids", T.BinaryType())
    end = int(separator).to_bytes(4, "little")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        turn = bpe.encoder(path, "library").encode
        owner, number, starts, parts = [], [], [], []
        for row, t in enumerate(batch.column(1).to_pylist()):
            ids = turn(t) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            for k, at in enumerate([0, *range(first, n, capacity)]):
                owner.append(row)
                number.append(k)
                starts.append(at)
                parts.append(ids[4 * at : 4 * (at + capacity if k else first)])
        columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if with_ids else []), names=out.names)

    return df.select(key, text).mapInArrow(lambda batches: bpe.by_slices(batches, work), out)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length its runs (first rank, ranks, first sequence, offset, copies in a sequence), by first rank.

    Best-fit decreasing: a length goes to the open sequence with the least
    room that still takes it. Sequences that have the same room and history
    form an interval and are filled together.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted
    opened = 0
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}

    def leave(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in room:
                bisect.insort(rooms, free)
            room.setdefault(free, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        mine = runs.setdefault(length, [])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
            else:
                free, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            copies = free // length
            full = min(count, left // copies)
            if full:
                mine.append((rank, full * copies, first, capacity - free, copies))
                rank, left = rank + full * copies, left - full * copies
                leave(free - copies * length, first, full)
            if left and full < count:  # fewer than a sequence takes
                mine.append((rank, left, first + full, capacity - free, left))
                leave(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(free, first + full, count - full)
    return runs


def assign(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``parts`` is read twice: pass a written table."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = {k: np.array(v, dtype=np.int64) for k, v in plan(histogram, capacity).items()}
    ranked = rank_within(parts, ["length"], list(order), "__rank")
    out = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    n, at = len(parts.columns), parts.columns.index("length")

    def work(batches):
        for batch in batches:
            lengths, ranks = batch.column(at).to_numpy(zero_copy_only=False), batch.column(n).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.nonzero(lengths == length)[0]
                table, r = runs[int(length)], ranks[own]
                run = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                inside, copies = r - run[:, 0], run[:, 4]
                sequence[own] = run[:, 2] + inside // copies
                offset[own] = run[:, 3] + inside % copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(work, out)


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places; ``with_ids`` keeps the token ids beside them."""
    return assign(Table(pieces(df, path, capacity, separator, with_ids=with_ids), "pieces").df, capacity)
