"""Quality rules: base counts, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word 1-grams and 2-grams are counted over whole
tables: one of all documents, one of the trusted ones. A document's ratio is
the mean, over its n-grams, of log(trusted share / corpus share); below
``LEAST_RATIO`` it is rejected. No document is sampled or skipped.

1-grams have a bucket for each 63-bit hash, so what is gathered grows with the
corpus's vocabulary and collisions don't. Words seen fewer than ``LEAST_SEEN``
times share one outcome. The weights of the most frequent words are broadcast;
occurrences of the others, a small share of all, meet their weights by a
shuffle. 2-grams have ``PAIR_BUCKETS`` buckets and one more for a word after
itself: most pairs of words occur once and say nothing, and a count of fixed
size combines in the task that reads the text. Weights are whole 100,000ths,
so sums don't depend on their order. Ratios belong to a text's 64-bit hash:
copies share one.

Everything is DataFrame functions; words are ``[^\\x20\\x09-\\x0D]+``.
``n_repeat_words`` compares 64-bit hashes of windows. Null texts have no words
and fail the base rules. A null doc_id is never trusted; rows that repeat are
judged alike, each once. Columns named like a result give way to it in
:func:`judge`; :func:`accepted` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, WORD, WORD_GAP, Table, few, when_small

#: Buckets of 2-grams; the one after them is that of a word after itself.
PAIR_BUCKETS = 1 << 17
#: Words seen less often share one weight.
LEAST_SEEN = 4
SCALE = 100_000
#: So many weights of words are broadcast at most: about 130 MB in an executor.
HEAD_ROWS = 2 * BROADCAST_ROWS
LEAST_RATIO = -0.25
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__t`` (text, never null), ``__h`` (a 64-bit hash of each word, in order)."""
    return df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__h", F.transform(F.array_remove(F.split("__t", WORD_GAP), ""), lambda w: F.xxhash64(w)))


def words(h: Column) -> Column:
    """Buckets of the 1-grams of a hash array: all negative."""
    return F.transform(h, lambda x: x.bitwiseOR(F.lit(-(1 << 63))))


def beside(h: Column) -> Column:
    """A hash of each word and the next one; its last bit says that they are the same."""
    first = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    both = lambda x, y: F.when(x == y, F.xxhash64(x, y).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(x, y).bitwiseAND(F.lit(-2)))
    return F.transform(first, lambda x, i: both(x, F.get(h, i + 1)))


def pair_bucket(p: Column) -> Column:
    """The bucket of a 2-gram, 0 to ``PAIR_BUCKETS``, from its hash of :func:`beside`."""
    return F.when(p.bitwiseAND(F.lit(1)) == 1, F.lit(PAIR_BUCKETS)).otherwise(F.shiftrightunsigned(p, 1).bitwiseAND(F.lit(PAIR_BUCKETS - 1)).cast("int"))


def base_counts(df: DataFrame) -> DataFrame:
    """Adds the base counts to rows that :func:`with_words` made."""
    t, h, n = F.col("__t"), F.col("__h"), F.size("__h")
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD))).withColumn("__b", beside(h))
    # five words are two pairs and a word
    windows = F.when(n >= WINDOW, F.transform(F.slice("__b", 1, n - WINDOW + 1), lambda p, i: F.xxhash64(p, F.get("__b", i + 2), F.get(h, i + 4)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__w", windows)
    w = F.col("__w")
    # where a window's hash has an equal neighbour once sorted, its place is covered, and so are the four words after it
    ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    last = F.size("__s") - 1
    again = F.filter(
        F.transform("__s", lambda p, k: F.when(((k > 0) & (F.get("__s", F.greatest(k - 1, F.lit(0)))["x"] == p["x"])) | ((k < last) & (F.get("__s", F.least(k + 1, last))["x"] == p["x"])), p["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(w)) < F.size(w), ordered))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(again)))
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")))["n"]
    chars = F.length(F.translate(t, GAPS, ""))
    df = df.select(
        "*",
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("__lines", "__w", "__s", "__p")


def counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, good) of every bucket in use, over all of ``docs``; ``trusted`` has the doc_ids of the target."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select("doc_id", "text").join(when_small(ids), F.col("doc_id") == F.col("__id"), "left")
    of_pairs = F.transform(beside(F.col("__h")), lambda p: pair_bucket(p).cast("long"))
    rows = with_words(rows, "text").select(F.col("__id").isNotNull().cast("int").alias("target"), F.explode(F.concat(words(F.col("__h")), of_pairs)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").cast("long").alias("good"))


def weigh(counted: DataFrame) -> tuple[DataFrame, int, Column]:
    """(weights of words as (bucket, raw, weight), weight of a rare word, weights of pairs as an array) of counts."""
    word, rare = F.col("bucket") < 0, (F.col("bucket") < 0) & (F.col("raw") < LEAST_SEEN)
    told = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    t = counted.agg(told("raw", word).alias("r1"), told("good", word).alias("g1"), told("raw", ~word).alias("r2"), told("good", ~word).alias("g2"), told("raw", rare).alias("r0"), told("good", rare).alias("g0"), F.count_if(word & ~rare).alias("n")).first()

    def weight(good, raw, all_good: int, all_raw: int, outcomes: int) -> Column:
        share = lambda c, n: F.log((c + F.lit(SMOOTHING)) / F.lit(n + SMOOTHING * outcomes))
        return F.round((share(good, all_good) - share(raw, all_raw)) * SCALE).cast("long") if all_good else F.lit(0).cast("long")

    spoken = weight(F.col("good"), F.col("raw"), t["g1"], t["r1"], t["n"] + 1)
    seldom = counted.sparkSession.range(1).select(weight(F.lit(t["g0"]), F.lit(t["r0"]), t["g1"], t["r1"], t["n"] + 1).alias("w")).first()["w"]
    of_pair = counted.where(~word).select("bucket", weight(F.col("good"), F.col("raw"), t["g2"], t["r2"], PAIR_BUCKETS + 1).alias("weight"))
    table = ["0"] * (PAIR_BUCKETS + 1)
    for r in of_pair.collect():  # as many rows as there are buckets of pairs, whatever the corpus
        table[r["bucket"]] = str(r["weight"])
    return counted.where(word & ~rare).select("bucket", "raw", spoken.alias("weight")), seldom, F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def word_means(docs: DataFrame, weights: DataFrame, seldom: int) -> DataFrame:
    """(fingerprint, mean weight of its words) of every text with words; the fingerprint is the text's hash."""
    bits = F.length(F.bin("raw"))
    least, room = 65, HEAD_ROWS
    for r in weights.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():  # 64 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["bits"]
    # the text's hash is a column before words are rows: else it would be worked out again for every word
    rows = with_words(docs.select("text"), "text").select(F.xxhash64("__t").alias("fingerprint"), words(F.col("__h")).alias("words")).select("fingerprint", F.explode("words").alias("word"))
    head = F.broadcast(weights.where(bits >= least).select(F.col("bucket").alias("word"), "weight"))
    rows = rows.join(head, "word", "left")
    if room >= 0:
        found = rows.groupBy("fingerprint").agg(F.sum(F.coalesce("weight", F.lit(seldom))).alias("total"), F.count("*").alias("n"))
    else:
        # what the head has is summed up before the shuffle; no other word is frequent, so none is a hot key
        missing = F.when(F.col("weight").isNull(), F.col("word"))
        part = Table(rows.groupBy("fingerprint", missing.alias("missing")).agg(F.sum("weight").alias("total"), F.count("*").alias("n")), "word-sums").df
        tail = weights.where(bits < least).select(F.col("bucket").alias("missing"), "weight")
        rest = part.where("missing is not null").join(tail, "missing", "left").select("fingerprint", (F.coalesce("weight", F.lit(seldom)) * F.col("n")).alias("total"), "n")
        both = part.where("missing is null").select("fingerprint", "total", "n").unionByName(rest)
        found = both.groupBy("fingerprint").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return found.select("fingerprint", (F.col("total") / F.col("n")).alias("mean"))


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """All columns of ``docs`` (but those with a name that follows) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept."""
    docs = docs.drop(*COUNTS, "ratio", "kept")
    counted = Table(counts(docs, trusted), "grams").df
    weights, seldom, of_pair = weigh(counted)
    means = Table(word_means(docs, weights, seldom).select(F.col("fingerprint").alias("__print"), F.col("mean").alias("__mean")), "means").df
    rows = base_counts(with_words(docs, "text"))
    total = F.aggregate("__b", F.lit(0).cast("long"), lambda acc, p: acc + F.get(of_pair, pair_bucket(p)))
    rows = rows.select(*docs.columns, *COUNTS, F.xxhash64("__t").alias("__own"), total.alias("__pairs"))
    rows = rows.join(F.broadcast(means) if few(means) else means, F.col("__own") == F.col("__print"), "left")
    n = F.col("n_words")
    ratio = F.when(~F.col("base_failed"), (F.col("__mean") * n + F.col("__pairs")) / (2 * n - 1) / F.lit(float(SCALE)))
    rows = rows.withColumn("ratio", ratio)
    kept = ~F.col("base_failed") & (F.col("ratio") >= LEAST_RATIO)
    # results leave through a generator: a caller's filter on one of them is then not rewritten into the array
    # expressions it comes from, which would work them out again for every element
    return rows.select(*docs.columns, F.inline(F.array(F.struct(*COUNTS, "ratio", F.coalesce(kept, F.lit(False)).alias("kept")))))


def accepted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns whatever their names."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("__row"))
    return judge(rows, trusted).where("kept").select("__row.*")
