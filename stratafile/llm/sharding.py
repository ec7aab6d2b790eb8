"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name;
the lowest draw wins, so a child gets its share of the weight.

A tree that was built keeps its draws. Weight that comes later is a *grant*: a
child with draws of its own beside the regions, for the added weight alone.
Whoever a grant wins descends in the part of the tree that it was made for: a
grant to a region goes on to its racks, one to a rack to its shards, one to a
shard ends there. Weight that is taken from a shard makes it keep a row only
with the share that is left, by one more draw; a row that it gives up descends
again with other draws, and at last joins the lowest draw of all shards. So a
change of weight moves rows only into or out of the subtree where it happened.

Null keys are one key of their own; equal rows share a shard and get slots of
their own. Slots count from 0 in each shard without gaps. Other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Table, rank_within

#: How often a row that a lightened shard gives up descends again.
TURNS = 4


@dataclass(frozen=True)
class Grant:
    """Weight added after the tree was built: to a region, one of its racks, or one shard (old or new) of a rack."""

    region: int
    rack: int | None
    shard: int | None
    weight: float


@dataclass(frozen=True)
class Tree:
    """``regions``: region -> rack -> shard -> weight, as nested tuples; ``grants``: later weight; ``kept``: (shard, share of its rows it keeps)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    grants: tuple[Grant, ...] = ()
    kept: tuple[tuple[int, float], ...] = ()

    def shards(self) -> list[int]:
        built = [s for region in self.regions for rack in region for s, _ in rack]
        return list(dict.fromkeys(built + [g.shard for g in self.grants if g.shard is not None]))

    def home(self, shard: int) -> tuple[int, int]:
        """The (region, rack) of a shard."""
        places = [(i, j) for i, region in enumerate(self.regions) for j, rack in enumerate(region) for s, _ in rack if s == shard]
        return (places + [(g.region, g.rack) for g in self.grants if g.shard == shard])[0]

    def weights(self) -> dict[int, float]:
        """What each shard weighs now; a grant to a rack or a region is shared out as it descends."""
        out = dict.fromkeys(self.shards(), 0.0)
        for region in self.regions:
            for rack in region:
                for s, w in rack:
                    out[s] += w
        built = {s: w for region in self.regions for rack in region for s, w in rack}
        for g in self.grants:
            racks = self.regions[g.region] if g.rack is None else (self.regions[g.region][g.rack],) if g.shard is None else ()
            inside = {s: built[s] for rack in racks for s, _ in rack} or {g.shard: 1.0}
            for s, w in inside.items():
                out[s] += g.weight * w / sum(inside.values())
        return {s: w * dict(self.kept).get(s, 1.0) for s, w in out.items()}

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in the rack with the fewest shards of the region with the fewest."""
        size = {(i, j): len(rack) for i, r in enumerate(self.regions) for j, rack in enumerate(r)}
        for g in self.grants:
            if g.shard is not None and all(s != g.shard for s, _ in self.regions[g.region][g.rack]):
                size[g.region, g.rack] += 1
        of_region = {i: sum(n for (k, _), n in size.items() if k == i) for i, _ in size}
        region, rack = min(size, key=lambda p: (of_region[p[0]], size[p], p))
        return replace(self, grants=(*self.grants, Grant(region, rack, max(self.shards()) + 1, weight)))

    def give(self, region: int, weight: float, rack: int | None = None) -> Tree:
        """More weight for a region or one of its racks."""
        return replace(self, grants=(*self.grants, Grant(region, rack, None, weight)))

    def reweigh(self, shard: int, weight: float) -> Tree:
        """The tree with another weight of a shard: more is a grant, less a share of its rows that it keeps."""
        now = self.weights()[shard]
        if weight >= now:
            return replace(self, grants=(*self.grants, Grant(*self.home(shard), shard, weight - now))) if weight > now else self
        shares = dict(self.kept)
        shares[shard] = shares.get(shard, 1.0) * weight / now
        return replace(self, kept=tuple(sorted(shares.items())))


def even_tree(n_regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
    numbers = iter(range(n_regions * racks * shards))
    return Tree(tuple(tuple(tuple((next(numbers), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(n_regions)))


def unit(key: Column, name: str) -> Column:
    """A number between 0 and 1 from the key and a name."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` from the key and the node's name."""
    return -F.log(unit(key, name)) / F.lit(weight)


def lowest(draws: list[tuple[Column, Column]]) -> Column:
    """The second of the pair whose first is least."""
    if len(draws) == 1:
        return draws[0][1]
    return F.least(*[F.struct(d.alias("draw"), to.alias("to")) for d, to in draws])["to"]


def weight_of(rack: tuple[tuple[int, float], ...]) -> float:
    return sum(w for _, w in rack)


def descend(tree: Tree, key: Column, turn: int = 0) -> Column:
    """The shard that a key comes down to."""
    mark = f"turn {turn} " if turn else ""

    def rack_of(i: int, j: int, via: str = "") -> Column:
        return lowest([(draw(key, f"{mark}{via}shard {s}", w), F.lit(s)) for s, w in tree.regions[i][j]])

    def region_of(i: int, via: str = "") -> Column:
        return lowest([(draw(key, f"{mark}{via}rack {i} {j}", weight_of(rack)), rack_of(i, j, via)) for j, rack in enumerate(tree.regions[i])])

    tops = [(draw(key, f"{mark}region {i}", sum(map(weight_of, region))), region_of(i)) for i, region in enumerate(tree.regions)]
    for k, g in enumerate(tree.grants):
        via = f"grant {k} "
        to = F.lit(g.shard) if g.shard is not None else rack_of(g.region, g.rack, via) if g.rack is not None else region_of(g.region, via)
        tops.append((draw(key, f"{mark}{via}region {g.region}", g.weight), to))
    return lowest(tops)


def place(tree: Tree, key: Column) -> Column:
    """The shard of a key."""
    if not tree.kept:
        return descend(tree, key).cast("int")
    # a row goes down again until a shard keeps it; the last turn draws among all shards with the weights they have now
    out = lowest([(draw(key, f"last shard {s}", w), F.lit(s)) for s, w in tree.weights().items() if w > 0])
    for turn in reversed(range(TURNS)):
        out = F.coalesce(_kept(tree, key, turn), out)
    return out.cast("int")


def _kept(tree: Tree, key: Column, turn: int) -> Column:
    """The shard that the key comes down to if it keeps the key, else null."""

    def keeps(shard: Column) -> Column:
        share = F.lit(1.0)
        for s, w in tree.kept:
            share = F.when(shard == s, F.lit(w)).otherwise(share)
        return F.when(unit(key, f"keep {turn}") < share, shard)

    return F.get(F.transform(F.array(descend(tree, key, turn)), keeps), F.lit(0))


def shard(df: DataFrame, tree: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    tree = tree or even_tree()
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    placed = df.select(F.col(key), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), place(tree, F.col(key)).alias("shard"), place(tree.grow(), F.col(key)).alias("grown_shard"))
    table = Table(placed, "placed").df
    ranked = rank_within(table, ["shard"], [key, "text_crc32", "size"], "slot")
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
