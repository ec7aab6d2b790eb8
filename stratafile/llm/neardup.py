"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Every whole text gives its set of five-word shingles, ``SAMPLES`` MinHash
   samples of it, band keys, and an odd sketch: the samples folded into
   ``BITS`` parity bits, so the XOR of two sketches counts the samples in which
   the two sets differ.
2. Texts with equal sets are one class, held by its smallest doc_id.
3. Classes that share a band key meet in a bucket. A large bucket is dealt into
   blocks before its rows are joined to anything, so no task gets more than a
   block of a key. Sketches decide which pairs are worth a look: ``FAR_BITS``
   lies more than five standard deviations beyond what two sets of similarity
   0.75 differ by.
4. Each block gives the spanning forest of its most similar pairs, not all
   pairs, and one head for each tree; heads of a bucket's blocks meet in turn.
   The pairs are confirmed on the full sets and joined into components.
5. Where ends are still apart in a bucket, the classes outside its largest
   component meet all of the bucket; those inside it don't meet each other.
   Pairs in sketch range get a second odd sketch, of the whole sets: each bit
   in which two of them differ is a shingle that only one set has, so it
   bounds the similarity from above without error. Every pair that the bound
   leaves is confirmed too, so at the end each pair in range is in one
   component or is known not to link.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z
lower-cased. With fewer than five words the whole sequence is the only
shingle; texts without words and nulls have an empty set and link with
nothing, as do rows without a doc_id. Rows that repeat a doc_id are one node of
the graph with the texts of all of them, and each keeps its own n_shingles.
Sets are compared as sets of 64-bit hashes of shingles: two shingles with one
hash would count as one, which for a pair of texts of a million shingles has a
chance of about 1e-7. Other columns, whatever their names, are left out by
:func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Table, components, few, join_popular, same, when_small

WORDS = 5
SAMPLES, BANDS = 128, 32
BITS, FAR_BITS = 512, 100
FINE_BITS = 8192
BLOCK = 512
LEAST_PERCENT = 75
CACHED_WORDS = 500_000


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (fixed values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = Hashes()
_PLACE = constants(WORDS + 1, 11)
_DRAWS = constants(SAMPLES, 23)
_SALTS = constants(SAMPLES, 37)
_IN_BAND = constants(SAMPLES // BANDS + 1, 41)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a whole text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(len(h), WORDS)
    total = np.full(len(h) - n + 1, np.uint64(n)) * _PLACE[WORDS]
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def samples(own: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.uint64(2**64 - 1))
    for at in range(0, len(own), 512):
        np.minimum(low, (_DRAWS[:, None] * own[None, at : at + 512]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = SAMPLES // BANDS
    total = (low.reshape(BANDS, rows) * _IN_BAND[None, :rows]).sum(axis=1, dtype=np.uint64)
    return mix(total + np.arange(BANDS, dtype=np.uint64) * _IN_BAND[rows]).view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """Parity of how many samples fall on each bit."""
    spots = mix(low + _SALTS) % np.uint64(BITS)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=BITS) & 1).tobytes()


def fine_sketch(own: np.ndarray) -> bytes:
    """Parity of how many of a set's shingles fall on each of ``FINE_BITS`` bits."""
    spots = (mix(own + _SALTS[0]) % np.uint64(FINE_BITS)).astype(np.int64)
    return np.packbits(np.bincount(spots, minlength=FINE_BITS) & 1).tobytes()


def estimate(differ: np.ndarray | int) -> np.ndarray:
    """Similarity from the number of bits in which two sketches differ."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(differ) / BITS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            n, h1, h2, keys, bits = [], [], [], [], []
            for text in part.column(1).to_pylist():
                own = shingles(text)
                n.append(len(own))
                if len(own):
                    low = samples(own)
                    whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    h1.append(int(whole[0]))
                    h2.append(int(whole[1]))
                    keys.append(band_keys(low))
                    bits.append(odd_sketch(low))
                else:
                    h1.append(None)
                    h2.append(None)
                    keys.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "keys", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Groups of (rep, component, size, sketch words, fine sketch words) from rows sorted by (key, a, b)."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 6)]
        words = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (6, 7)]
        now = [group, *columns, *words]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cuts = np.nonzero((now[0][1:] != now[0][:-1]).any(axis=1))[0] + 1
        edges = [0, *cuts.tolist()]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield [x[i:j] for x in now[1:]]
        rest = [x[edges[-1] :] for x in now]
    if rest is not None:
        yield rest[1:]


def _differ(words: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count(words ^ words[i]).sum(axis=1, dtype=np.int64)


def forest(rep: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the spanning forest of most similar pairs within ``FAR_BITS``."""
    out = []
    n = len(rep)
    nearest, via = np.full(n, BITS + 1), np.full(n, -1)
    left = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        gap = _differ(words, at)
        closer = left & (gap < nearest)
        nearest[closer], via[closer] = gap[closer], at
        at = int(np.where(left, nearest, BITS + 2).argmin())
        if nearest[at] <= FAR_BITS:
            out.append((int(rep[via[at]]), int(rep[at])))
    return out


def apart(rep: np.ndarray, comp: np.ndarray, size: np.ndarray, words: np.ndarray, fine: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs within ``FAR_BITS`` whose components differ and whose fine sketches leave enough similarity."""
    if (comp == comp[0]).all():
        return
    for i in range(len(rep) - 1):
        j = np.nonzero((comp[i + 1 :] != comp[i]) & (_differ(words[i:], 0)[1:] <= FAR_BITS))[0] + i + 1
        if len(j):
            # at least ``gap`` shingles are in one set only, so the sets share (total - gap) / 2 at most
            gap = np.bitwise_count(fine[j] ^ fine[i]).sum(axis=1, dtype=np.int64)
            total = size[j] + size[i]
            for k in j[100 * (total - gap) >= LEAST_PERCENT * (total + gap)]:
                yield int(rep[i]), int(rep[k])


def _grouped(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows as :func:`_runs` reads them: each (key, a, b) together."""
    told = rows.select("key", F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), "rep", "component", "size", "sketch", "fine")
    return told.repartition(F.col("key"), F.col("a"), F.col("b")).sortWithinPartitions("key", "a", "b", "rep")


def _dealt(rows: DataFrame, n: str) -> DataFrame:
    """Adds ``parts``, how many blocks the bucket of ``n`` rows has, and ``own``, the row's block."""
    rows = rows.withColumn("parts", F.ceil(F.col(n) / F.lit(BLOCK)).cast("int"))
    return rows.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("parts")).cast("int"))


def _pairs(rows: DataFrame, work) -> DataFrame:
    """The distinct pairs (u, v), u < v, that ``work`` finds in each group of :func:`_grouped` rows; a single node is (u, u)."""

    def turn(batches):
        us, vs = [], []
        make = lambda: pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        for group in _runs(batches):
            for u, v in work(*group):
                us.append(min(u, v))
                vs.append(max(u, v))
                if len(us) >= 100_000:
                    yield make()
                    us, vs = [], []
        yield make()

    return rows.mapInArrow(turn, "u long, v long").distinct()


def _forest_and_heads(rep, comp, size, words, fine) -> Iterator[tuple[int, int]]:
    links = forest(rep, words)
    yield from links
    yield from ((int(r), int(r)) for r in set(rep.tolist()) - {v for _, v in links})


def _every_part(rows: DataFrame, parts: str, other: str, but_own: bool) -> DataFrame:
    """Rows for each block of their bucket; one row where there is a single block."""
    all_ = F.sequence(F.lit(0), F.col(parts) - 1)
    some = F.when(F.col(parts) == 1, F.array(F.lit(0))).otherwise(F.filter(all_, lambda x: x != F.col("own"))) if but_own else all_
    return rows.withColumn(other, F.explode(some))


def _meet_heads(dealt: DataFrame) -> DataFrame:
    """Pairs that connect each bucket's candidates: forests of blocks, then forests of the heads of a large bucket's trees."""
    plain = lambda rep, comp, size, words, fine: forest(rep, words)
    found = _pairs(_grouped(dealt.where("parts = 1"), "own", "own"), plain)
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return found
    first = Table(_pairs(_grouped(large, "own", "own"), _forest_and_heads), "block-pairs").df
    heads = large.join(first.where("u = v").select(F.col("u").alias("rep")), "rep", "left_semi")
    counts = Table(heads.groupBy("key").agg(F.count("*").alias("n_heads")).select(F.col("key").alias("__k"), "n_heads"), "heads").df
    met = heads.join(F.broadcast(counts) if few(counts) else counts, F.col("key") == F.col("__k"))
    met = _every_part(_dealt(met, "n_heads"), "parts", "other", True)
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return found.unionByName(first.where("u < v")).unionByName(_pairs(_grouped(met, "lo", "hi"), plain)).distinct()


def _meet_apart(dealt: DataFrame, fines: DataFrame) -> DataFrame:
    """All pairs in sketch range of each bucket whose components differ, (u, v) with u < v."""
    sizes = dealt.groupBy("key", "component").agg(F.count("*").alias("m"))
    top = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    top = Table(top.select(F.col("key").alias("__k"), F.col("top.component").alias("main"), (F.col("all") - F.col("top.m")).alias("n_out")).where("n_out > 0"), "apart-buckets").df
    rows = dealt.join(F.broadcast(top) if few(top) else top, F.col("key") == F.col("__k")).join(fines, "rep")
    rows = rows.withColumn("out", F.col("component") != F.col("main")).withColumn("outs", F.ceil(F.col("n_out") / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(F.lit(6), "rep"), F.col("outs")).cast("int"))
    # classes outside the main component meet each block of those inside, and each other, two blocks at a time
    among = rows.where("out and outs > 1").withColumn("own", F.col("mine"))
    among = _every_part(among, "outs", "other", True).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    across = _every_part(rows.where("out"), "parts", "inner", False).withColumn("lo", -1 - F.col("mine")).withColumn("hi", F.col("inner"))
    across = across.drop("inner").unionByName(_every_part(rows.where("not out"), "outs", "to", False).withColumn("lo", -1 - F.col("to")).withColumn("hi", F.col("own")).drop("to"))
    columns = ["key", "lo", "hi", "rep", "component", "size", "sketch", "fine"]
    return _pairs(_grouped(among.select(*columns).unionByName(across.select(*columns)), "lo", "hi"), apart)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("own").alias("x"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("own").alias("y"))

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                good.append(100 * inter >= LEAST_PERCENT * (len(x) + len(y) - inter))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(work, "u long, v long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            own = [shingles(t) for t in part.column(1).to_pylist()]
            columns = [pa.array([f(x) for x in own], pa.binary()) for f in (np.ndarray.tobytes, fine_sketch)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([len(x) for x in own], pa.int64())], names=["doc_id", "own", "fine", "size"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``df``."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long_ = T.LongType()
    schema = T.StructType([T.StructField("doc_id", long_), T.StructField("n_shingles", long_), T.StructField("h1", long_), T.StructField("h2", long_), T.StructField("keys", T.ArrayType(long_)), T.StructField("sketch", T.BinaryType())])
    seen = Table(docs.mapInArrow(_sketches, schema), "sketches").df
    full = seen.where("h1 is not null and doc_id is not null")
    twins = full.groupBy(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twins = Table(twins, "twins").df
    twin = [("h1", "__h1"), ("h2", "__h2")]
    classes = join_popular(full, twins, twin, "n", nulls=False).where("first is null or first = doc_id").select(F.col("doc_id").alias("rep"), "keys", "sketch")
    classes = Table(classes, "classes").df

    keyed = classes.select("rep", F.explode("keys").alias("key"))
    spot = F.xxhash64("rep")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(spot).alias("x"), F.sum(spot.cast("decimal(20,0)")).alias("s")).where("n > 1")
    shared = shared.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n")  # buckets with the same members count once
    shared = Table(shared, "buckets").df
    # large buckets are known before the join, so that their rows go to it in blocks
    large = when_small(shared.where(F.col("n") > BLOCK).select(F.col("key").alias("__k"), F.col("n").alias("many")))
    keyed = keyed.join(large, F.col("key") == F.col("__k"), "left").withColumn("many", F.coalesce("many", F.lit(1))).drop("__k")
    keyed = _dealt(keyed, "many").drop("parts", "many")
    shared = shared.withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    shared = shared.select("key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    rows = keyed.join(shared, ["key", "own"]).join(classes.select("rep", "sketch"), "rep")
    rows = Table(rows.select("key", "parts", "own", "rep", "sketch"), "bucket-rows")

    start = rows.df.withColumn("component", F.col("rep")).withColumn("size", F.lit(0).cast("long")).withColumn("fine", F.lit(b"\0" * 8))
    first = Table(_meet_heads(start), "pairs").df
    ends = first.select(F.col("u").alias("doc_id")).unionByName(first.select(F.col("v").alias("doc_id"))).distinct()
    texts = docs.join(ends.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = Table(texts.mapInArrow(_sets, "doc_id long, own binary, fine binary, size long"), "sets")
    links = Table(_confirmed(first, sets.df), "links").df
    comps = Table(components(links, "u", "v"), "components").df
    fines = sets.df.select(F.col("doc_id").alias("rep"), "size", "fine")
    apart_rows = rows.df.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart_rows = Table(apart_rows, "apart-rows")
    second = _meet_apart(apart_rows.df, fines).join(first, ["u", "v"], "left_anti")
    more = Table(_confirmed(second, sets.df), "more-links").df
    for done in (sets, rows, apart_rows):
        done.drop()
    if not more.isEmpty():
        comps = Table(components(links.unionByName(more), "u", "v"), "components").df
    # copies get their component with their class, so a text with many of them is no join key
    ends = comps.select(F.col("node").alias("__node"), "component")
    facts = Table(twins.join(ends, F.col("first") == F.col("__node"), "left").select("__h1", "__h2", "n", F.coalesce("component", "first").alias("class")), "facts").df
    members = seen.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    members = join_popular(members, facts, twin, "n").select("doc_id", "n_shingles", "class")
    alone = members.where("class is null").join(ends, F.col("doc_id") == F.col("__node"), "left")
    out = members.where("class is not null").unionByName(alone.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("class")))
    out = out.select(F.col("doc_id").alias(key), "n_shingles", F.col("class").alias("component_id"))
    return out.withColumn("kept", same(F.col(key), F.col("component_id")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` but those whose doc_id is in a component and isn't its smallest."""
    found = near_duplicates(df, key, text)
    gone = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__gone")).agg(F.bool_or("kept").alias("__kept")).where("not __kept").select("__gone")
    return df.join(gone.hint("shuffle_hash"), df[key] == F.col("__gone"), "left_anti")
