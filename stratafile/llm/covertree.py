"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Vectors become unit vectors, so cosine >= c is a distance <= sqrt(2 - 2c).
Equal vectors of a label are one weighted point. The points of a label are
dealt into cells around pivots, at most ``PIVOT_BYTES`` of them in all (cells
are larger where the table is), and a crowded cell into blocks by a hash. A
point can only link into a cell whose pivot is no further from it than its own
cell's pivot and twice the reach, and no further than the cell's radius and
the reach: it goes to those cells alone, before anything is copied. For each
pair of blocks that have points to compare one task builds a cover tree of
either side - nested levels, radii halving from level to level - and descends
both at once: a pair of nodes further apart than their covering radii allow
goes, everything else ends at pairs of points that are compared in double
precision. A task returns counts of links and a spanning forest of them, never
the pairs, so a group of copies costs a row for each copy.

Null, zero and non-finite vectors and vectors without a label link with
nothing. Labels are compared as they are, by their text. Rows that repeat a
vec_id are separate vectors for the counts and one node for the components;
rows with a null vec_id link with nothing. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Table, components, few, join_popular, same

#: Points of a block.
BLOCK = 4096
#: All pivots together take at most so much: they are known to every task.
PIVOT_BYTES = 16 << 20
LEAF_RADIUS = 0.05
SLACK = 1e-6
TILE = 1024


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Each vector divided by its norm, as doubles; None for one that links with nothing."""
    out: list[bytes | None] = []
    for vector in column:
        values = vector.values
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # keeps the squares of very large and very small components in range
        out.append((x / math.sqrt(float(x @ x))).tobytes())
    return out


class CoverTree:
    """Nested levels of nodes over unit vectors; node k of a level covers points[begin:end] within its radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.arange(len(x))
        self.center, self.begin, self.end, self.radius, self.children = [], [], [], [], []
        self.order = order
        if len(x):
            self._node(0, len(x), 2.0)

    def _node(self, begin: int, end: int, scale: float) -> int:
        """Puts the node of order[begin:end] and all below it; the first point is the center."""
        own = self.order[begin:end]
        gaps = distances(self.x[own[:1]], self.x[own])[0]
        k = len(self.center)
        self.center.append(own[0])
        self.begin.append(begin)
        self.end.append(end)
        self.radius.append(float(gaps.max()) if end - begin > 1 else 0.0)
        self.children.append(())
        while scale > LEAF_RADIUS and scale / 2 >= self.radius[k]:
            scale /= 2  # levels at which the node would have itself as its only child
        if end - begin > 1 and self.radius[k] > LEAF_RADIUS:
            below = []
            at = begin
            for part in self._net(own, scale / 2):
                self.order[at : at + len(part)] = part
                below.append((at, at + len(part)))
                at += len(part)
            self.children[k] = tuple(self._node(a, b, scale / 2) for a, b in below)
        return k

    def _net(self, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Greedy net: centers further apart than ``radius``; a point goes to the first center that covers it."""
        parts, left = [], own
        while len(left):
            heads = left[:64]
            near = distances(self.x[heads], self.x[left]) <= radius
            open_ = np.ones(len(left), bool)
            for i in range(len(heads)):
                if open_[i]:
                    took = near[i] & open_
                    took[i] = True
                    inside = left[took]
                    parts.append(np.concatenate([heads[i : i + 1], inside[inside != heads[i]]]))
                    open_ &= ~took
            left = left[open_]
        return parts


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Links:
    """Link counts and a union-find over the points of two blocks (the same block twice: one set of points)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.count = np.zeros(len(weights), np.int64)
        self.parent = np.arange(len(weights))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.parent
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.parent = up.copy()
        return up

    def add(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray, both: bool) -> None:
        """``linked``: which of rows x cols link; ``both``: count for the columns too."""
        if not linked.any():
            return
        self.count[rows] += linked @ self.weights[cols]
        if both:
            self.count[cols] += self.weights[rows] @ linked
        while True:
            up = self.roots()
            apart = linked & (up[rows][:, None] != up[cols][None, :])
            i = np.nonzero(apart.any(axis=1))[0]
            if not len(i):
                return
            for r, c in zip(rows[i], cols[apart[i].argmax(axis=1)], strict=True):
                self.union(int(r), int(c))


def dual(a: CoverTree, b: CoverTree, shift: int, cosine: float, links: Links) -> None:
    """All links between the trees; ``shift``: number of b's first point in ``links`` (0 if b is a).

    The stack holds pairs of node lists still to be compared; a list with
    itself stands for its unordered pairs. Each step goes down on one side at
    least and keeps only nodes that the covering radii leave in reach.
    """
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = np.array(a.center, int), np.array(b.center, int)
    leaf_a, leaf_b = np.array([not k for k in a.children]), np.array([not k for k in b.children])

    def in_reach(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return distances(a.x[ca[i]], b.x[cb[j]]) <= ra[i][:, None] + rb[j][None, :] + reach

    def points(nodes: np.ndarray, tree: CoverTree) -> np.ndarray:
        return np.concatenate([tree.order[tree.begin[k] : tree.end[k]] for k in nodes])

    def compare(rows: np.ndarray, cols: np.ndarray, itself: bool) -> None:
        for p in range(0, len(rows), TILE):
            for q in range(p if itself else 0, len(cols), TILE):
                r, c = rows[p : p + TILE], cols[q : q + TILE]
                linked = a.x[r] @ b.x[c].T >= cosine
                if itself and p == q:
                    np.fill_diagonal(linked, False)
                links.add(r, c + shift, linked, not (itself and p == q))

    def leaves(i: np.ndarray, j: np.ndarray, itself: bool) -> None:
        for p in range(0, len(i), TILE):
            for q in range(p if itself else 0, len(j), TILE):
                rows, cols = i[p : p + TILE], j[q : q + TILE]
                near = in_reach(rows, cols)
                if itself and p == q:
                    np.fill_diagonal(near, [a.end[k] - a.begin[k] > 1 for k in rows])
                    rows = cols = rows[near.any(axis=1) | near.any(axis=0)]
                else:
                    rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
                if len(rows) and len(cols):
                    compare(points(rows, a), points(cols, b), itself and p == q)

    top = np.array([0])
    stack = [(top, top, b is a)] if a.center and b.center else []
    while stack:
        left, right, itself = stack.pop()
        ends, inner = left[leaf_a[left]], left[~leaf_a[left]]
        other_ends, other_inner = right[leaf_b[right]], right[~leaf_b[right]]
        leaves(ends, other_ends, itself)
        for k in inner:
            below = np.array(a.children[k])
            if itself:
                stack.append((below, below, True))
            beside = np.concatenate([ends, inner[inner > k]]) if itself else right
            beside = beside[in_reach(np.array([k]), beside)[0]]
            if len(beside):
                stack.append((below, beside, False))
        for q in other_inner if not itself and len(ends) else ():
            beside = ends[in_reach(ends, np.array([q]))[:, 0]]
            if len(beside):
                stack.append((beside, np.array(b.children[q]), False))


def link_blocks(x: np.ndarray, weights: np.ndarray, cosine: float, y: np.ndarray | None = None, y_weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(link counts, smallest-numbered point of the component) inside x, or between x and y (numbered after x)."""
    if y is None:
        links = Links(weights)
        tree = CoverTree(x)
        dual(tree, tree, 0, cosine, links)
    else:
        links = Links(np.concatenate([weights, y_weights]))
        dual(CoverTree(x), CoverTree(y), len(x), cosine, links)
    return links.count, links.roots()


def settle(units: list[bytes], pivots: dict[int, np.ndarray], reach: float) -> list[tuple[int, float, list[int], list[float]]]:
    """For each unit vector of a label its cell, the distance to that cell's pivot, and the cells it may link into with theirs.

    ``pivots``: for each length of vectors the pivots of that length, all others far away.
    """
    out: list = [None] * len(units)
    by_width: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_width.setdefault(len(u) // 8, []).append(i)
    for width, own in by_width.items():
        if width not in pivots:  # no pivot has this length: a cell of its own
            for i in own:
                out[i] = (-width, 0.0, [-width], [0.0])
            continue
        names, points = pivots[width]
        for at in range(0, len(own), TILE):
            part = own[at : at + TILE]
            gap = distances(np.array([np.frombuffer(units[i]) for i in part]), points)
            for i, row in zip(part, gap, strict=True):
                home = int(row.argmin())
                near = np.nonzero(row <= row[home] + 2 * reach)[0]
                out[i] = (int(names[home]), float(row[home]), names[near].tolist(), row[near].tolist())
    return out


def choose_pivots(points: DataFrame, block: int) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Pivots of the labels with more points than a block: of each bucket of hashes the point with the lowest one."""
    sizes = Table(points.groupBy("label").agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")), "labels").df
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("bytes"), F.lit(8)).alias("b")).first()
    step = max(block, -(-total["n"] * total["b"] // PIVOT_BYTES))
    many = sizes.where(F.col("n") > step).select("label", F.ceil(F.col("n") / F.lit(step)).cast("long").alias("buckets"))
    spread = points.join(F.broadcast(many), "label").withColumn("bucket", F.pmod(F.xxhash64("rep"), F.col("buckets")))
    chosen = spread.groupBy("label", "bucket").agg(F.min(F.struct(F.xxhash64(F.lit(1), "rep"), "unit"))["unit"].alias("pivot"))
    found: dict = {}
    for r in chosen.orderBy("label", "bucket").collect():  # at most 2 * PIVOT_BYTES
        found.setdefault(r["label"], {}).setdefault(len(r["pivot"]) // 8, []).append((r["bucket"], np.frombuffer(bytes(r["pivot"]))))
    return {label: {w: (np.array([k for k, _ in own]), np.array([p for _, p in own])) for w, own in by_width.items()} for label, by_width in found.items()}


def near_duplicates(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("unit", T.BinaryType())])
    reach = math.sqrt(2 - 2 * cosine) + SLACK

    def prepare(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit_rows(batch.column(2)), pa.binary())], names=["vec_id", "label", "unit"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    units = Table(rows.mapInArrow(prepare, schema), "units").df
    units = units.withColumn("twin", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.sha2(F.concat(F.col("unit"), F.encode(F.col("label"), "UTF-8")), 256)))
    points = units.where("twin is not null").groupBy("twin").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("unit").alias("unit"))
    points = Table(points, "points").df
    pivots = choose_pivots(points, block)

    n_cols = ["rep", "copies", "label", "unit"]
    far = T.ArrayType(T.StructType([T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())]))
    settled = T.StructType([*[points.schema[c] for c in n_cols], T.StructField("home", T.LongType()), T.StructField("gap", T.DoubleType()), T.StructField("near", far)])

    def deal(batches):
        for batch in batches:
            labels, found = batch.column(2).to_pylist(), [None] * batch.num_rows
            units_ = batch.column(3).to_pylist()
            own: dict = {}
            for i, x in enumerate(labels):
                own.setdefault(x, []).append(i)
            for x, at in own.items():
                told = settle([units_[i] for i in at], pivots[x], reach) if x in pivots else [(0, 0.0, [0], [0.0])] * len(at)
                for i, t in zip(at, told, strict=True):
                    found[i] = t
            near = [[{"cell": c, "gap": g} for c, g in zip(f[2], f[3], strict=True)] for f in found]
            arrays = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()), pa.array(near, pa.list_(pa.struct([("cell", pa.int64()), ("gap", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=settled.names)

    homed = Table(points.select(*n_cols).mapInArrow(deal, settled), "homed").df
    cells = homed.groupBy("label", "home").agg(F.count("*").alias("m"), F.max("gap").alias("radius"))
    cells = Table(cells.withColumn("parts", F.ceil(F.col("m") / F.lit(block)).cast("long")).drop("m"), "cells").df
    mine = cells.select(F.col("label").alias("__l"), F.col("home").alias("__h"), F.col("parts").alias("__p"))
    meets = lambda t: F.broadcast(t) if few(t) else t
    dealt = homed.join(meets(mine), (F.col("label") == F.col("__l")) & (F.col("home") == F.col("__h")))
    dealt = dealt.withColumn("own", F.struct("home", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("__p")).alias("part")))
    sent = dealt.select("rep", "copies", "label", "unit", "own", F.explode("near").alias("to"))
    theirs = cells.select(F.col("label").alias("__l"), F.col("home").alias("__h"), "radius", "parts")
    sent = sent.join(meets(theirs), (F.col("label") == F.col("__l")) & (F.col("to.cell") == F.col("__h"))).where(F.col("to.gap") <= F.col("radius") + reach)
    sent = sent.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.col("__h").alias("home"), k.alias("part")))))
    sent = sent.select("rep", "copies", "unit", "label", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).cast("int").alias("own"))

    def compare(group: pa.Table) -> pa.Table:
        itself = group.column("a")[0].as_py() == group.column("b")[0].as_py()
        own = group.column("own").to_numpy()
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        unit = [np.frombuffer(u) for u in group.column("unit").to_pylist()]
        count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for width in {len(u) for u in unit}:  # vectors of different lengths never link
            fits = np.array([len(u) == width for u in unit])
            p = np.nonzero(fits & (own == 1))[0]
            p = p[np.argsort(rep[p])]
            q = p[:0] if itself else np.nonzero(fits & (own == 0))[0]
            both = np.concatenate([p, q])
            if itself:
                c, r = link_blocks(np.array([unit[i] for i in p]), copies[p], cosine)
            elif len(p) and len(q):
                c, r = link_blocks(np.array([unit[i] for i in p]), copies[p], cosine, np.array([unit[i] for i in q]), copies[q])
            else:
                continue
            count[both], root[both] = c, both[r]
        some = (count > 0) | (root != np.arange(len(rep)))
        return pa.table({"rep": rep[some], "links": count[some], "root": rep[root[some]]})

    found = sent.groupBy("label", "a", "b").applyInArrow(compare, "rep long, links long, root long")
    found = Table(found, "links").df
    counts = found.groupBy(F.col("rep").alias("__rep")).agg(F.sum("links").alias("__links"))
    comps = components(found, "rep", "root").withColumnRenamed("node", "__node")
    ends = points.join(counts, F.col("rep") == F.col("__rep"), "left").join(comps, F.col("rep") == F.col("__node"), "left")
    ends = ends.select(F.col("twin").alias("__twin"), "copies", (F.coalesce("__links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = join_popular(units.select("vec_id", "twin"), Table(ends, "ends").df, [("twin", "__twin")], "copies")
    out = out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", same(F.col(key), F.col("component_id")))
