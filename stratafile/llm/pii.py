"""Personal data: base patterns, then bootstrapped contextual extraction.

Base spans come from four fixed patterns (e-mail, IP, card, phone). Together
with long hexadecimal keys they are the seed entities. The two words before an
entity are its lexical pattern; the corpus gives a bipartite graph of patterns
and instances (every identifier-like token). A base span that covers several
words is one instance, and its words are none; its pattern is the two words
before the word it begins in. In each of ``ROUNDS`` turns a
pattern's confidence is the share of all its places in the corpus that a
trusted instance follows, and an instance's is one minus the chance that all
its patterns of at least ``CONFIDENT`` are wrong. Identifier-like tokens after
such patterns are added as spans of kind ``context``; base spans stay.

A pattern can't become confident once more places are known than its tokens
could ever vouch for. So places are first counted in shares of the documents,
which rules out common word pairs, and the rest over all documents.

DataFrame functions only. Offsets are code points, ends exclusive. A null text
counts as empty. Rows with the same doc_id and the same text have the same
spans; a null doc_id is a value like any other. Columns named like a result
are left out by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_GAP, Table, few, same, when_small

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, CONFIDENT, LEAST_SUPPORT = 3, 0.8, 3
#: One in so many documents is looked at before all are; results don't depend on it.
SHARES = (16, 4)

# A match can only begin where a run of the pattern's first class begins or where the last match ended,
# so a long run that leads nowhere is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit or an @ in them.
TOKEN = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
HEX_KEY = r"^[0-9a-fA-F]{32,}$"
#: An identifier: six or more letters, digits and joining marks, a digit among them, no decimal number.
IDENTIFIER = r"^(?=.*[0-9])[A-Za-z0-9@_+=/.:-]{6,}$"


#: Long arrays are folded in runs of so many, so the work doesn't grow with the square of their length.
RUN = 256


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_runs(items: Column) -> Column:
    """An array cut into arrays of at most ``RUN``."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k, RUN))


def running(values: Column, step) -> Column:
    """What ``step``, a sum or a maximum from 0, comes to at each place of an array<int>: inside each run, and over the runs."""
    fold = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    rest = lambda xs: F.slice(xs, 2, RUN)

    def over(runs: Column) -> Column:
        whole = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), step))
        return bound(fold(whole, F.lit(0)), lambda at: F.flatten(F.transform(runs, lambda r, k: rest(fold(r, F.get(at, k))))))

    return bound(values, lambda v: bound(in_runs(v), over))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of all matches, leftmost first."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("m"), between.alias("b")), lambda x: x["m"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: F.length(x["b"]) + F.length(x["m"])), lambda a, b: a + b)
        return F.transform(F.arrays_zip(pairs.alias("p"), ends.alias("e")), lambda x: F.struct(x["p"]["m"].alias("m"), (x["e"] - F.length(x["p"]["m"])).alias("start"), x["e"].alias("end")))

    return bound(pairs, placed)


def small_part(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(digits) <= 3, digits.cast("int") <= 255).otherwise(False)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), small_part)
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind (place in KINDS), start, end>> of the four base kinds."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    parts = []
    for k, (kind, pattern, needs) in enumerate((("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"), ("card", CARD, r"[0-9][\x20-]?[0-9]"), ("phone", PHONE, r"\+[0-9]"))):
        good = F.filter(matches(text, pattern), lambda x: passes(kind, x["m"]))  # noqa: B023
        parts.append(F.when(text.rlike(needs), F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).otherwise(none))  # noqa: B023
    return F.concat(*parts)


def plain_word(word: Column) -> Column:
    """A context word: lower case; anything with a digit or an @ stands for any other."""
    return F.when(word.rlike("[0-9@]"), "#").otherwise(F.lower(word))


def context(before_last: Column, last: Column) -> Column:
    return F.xxhash64(before_last, last)


def tokens(text: Column, base: Column) -> Column:
    """array<struct<pattern, instance, start, end, key, wide>> of identifier-like tokens and base spans of several words, and what stands before them.

    ``base`` must be a column of its own: it is read once for every token.
    """
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, led = F.size(words), F.concat(F.array(F.lit("^"), F.lit("^")), words)
    # matches of TOKEN are the words with a digit or an @, in the same order
    own = F.filter(F.arrays_zip(F.slice(led, 1, n).alias("a"), F.slice(led, 2, n).alias("b"), words.alias("w")), lambda x: x["w"].rlike("[0-9@]"))
    found = F.arrays_zip(matches(text, TOKEN).alias("t"), own.alias("c"))
    found = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["t"]["start"]) & (x["t"]["start"] < b["end"])))

    def one(x: Column) -> Column:
        t, c = x["t"], x["c"]
        lead = F.length(F.regexp_extract(t["m"], "^[^A-Za-z0-9+]*", 0))
        core = F.regexp_replace(F.substring(t["m"], lead + 1, F.length(t["m"])), "[^A-Za-z0-9]+$", "")
        span = F.get(F.filter(base, lambda b: (t["start"] <= b["start"]) & (b["start"] < t["end"]) & (t["end"] < b["end"])), F.lit(0))
        wide = span.isNotNull()
        instance = F.when(wide, F.substring(text, span["start"] + 1, span["end"] - span["start"])).otherwise(core)
        # a mark that stands before the token within its word belongs to neither
        start = F.when(wide, span["start"]).otherwise(t["start"] + lead)
        end = F.when(wide, span["end"]).otherwise(t["start"] + lead + F.length(core))
        pattern = context(plain_word(c["a"]), plain_word(c["b"]))
        return F.struct(pattern.alias("pattern"), instance.alias("instance"), start.alias("start"), end.alias("end"), core.rlike(HEX_KEY).alias("key"), wide.alias("wide"))

    none = F.array().cast("array<struct<pattern:bigint,instance:string,start:int,end:int,key:boolean,wide:boolean>>")
    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(found, one), lambda x: x["wide"] | x["instance"].rlike(IDENTIFIER))).otherwise(none)


def places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, places): how often the two words of each wanted pattern stand in the corpus."""
    words = F.transform(F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), ""), plain_word)
    rows = docs.select(F.concat(F.array(F.lit("^"), F.lit("^")), words).alias("w"))
    rows = rows.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    rows = rows.select(context(F.col("p.a"), F.col("p.b")).alias("pattern"))
    # few patterns are looked up where the words are; many only meet what the tasks have counted
    count = lambda df: df.groupBy("pattern").agg(F.count("*").alias("places"))
    return count(rows.join(F.broadcast(wanted), "pattern", "left_semi")) if few(wanted) else count(rows).join(wanted, "pattern", "left_semi")


def confident_patterns(read: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, confidence) after ``ROUNDS`` turns over the graph of patterns and instances."""
    inside = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    each = read.select("base", F.explode("tokens").alias("t")).select(F.col("t.pattern").alias("pattern"), F.xxhash64("t.instance").alias("instance"), (F.col("t.key") | inside(F.col("t"))).alias("seed"))
    edges = Table(each.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed")), "graph").df
    # a pattern without enough seeds now may gain trusted instances in a later turn, so all with enough instances are counted
    most = (F.sum("n") / F.lit(CONFIDENT)).alias("most")
    wanted = Table(edges.groupBy("pattern").agg(F.count("*").alias("k"), most).where(F.col("k") >= LEAST_SUPPORT).select("pattern", "most"), "wanted").df
    for share in SHARES:
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
        known = wanted.join(places(part, wanted.select("pattern")), "pattern", "left")
        wanted = Table(known.where("places is null or places <= most").select("pattern", "most"), "wanted").df
    counted = Table(places(docs, wanted.select("pattern")), "places").df
    edges = Table(edges.join(counted, "pattern"), "graph").df
    trust = None
    patterns = None
    for turn in range(ROUNDS):
        known = edges.withColumn("trust", F.col("seed").cast("double"))
        if trust is not None:
            known = edges.join(trust, "instance", "left").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))))
        share = F.sum(F.col("n") * F.col("trust")) / F.greatest(F.max("places"), F.sum("n"))
        scored = known.groupBy("pattern").agg(share.alias("confidence"), F.count_if(F.col("trust") >= CONFIDENT).alias("support")).where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= CONFIDENT))
        patterns = Table(scored.select("pattern", "confidence"), f"patterns{turn}").df
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        trust = edges.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("trust"))
    return patterns


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, base, spans) for every row; spans are structs (kind, start, end), sorted."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = rows.select("doc_id", F.xxhash64("text").alias("fingerprint"), F.array_sort(F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("base"), "text")
    read = Table(read.select("doc_id", "fingerprint", "base", tokens(F.col("text"), F.col("base")).alias("tokens")), "spans").df
    good = when_small(confident_patterns(read, rows).select("pattern"))
    outside = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = read.select("doc_id", "fingerprint", "base", F.explode("tokens").alias("t")).where(outside(F.col("t"))).select("doc_id", "fingerprint", F.col("t.pattern").alias("pattern"), "t")
    more = more.join(good, "pattern", "left_semi").groupBy(F.col("doc_id").alias("__doc"), F.col("fingerprint").alias("__print")).agg(F.collect_set(F.struct(F.col("t.start").alias("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("t.end").alias("end"))).alias("added"))
    joined = read.join(more, same(F.col("doc_id"), F.col("__doc")) & (F.col("fingerprint") == F.col("__print")), "left")
    return joined.select("doc_id", "fingerprint", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_numbers(spans: str) -> list[Column]:
    """How many spans of each base kind a column of spans has."""
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]


def report(found: DataFrame) -> DataFrame:
    """Counts and lists of a result of :func:`find`."""
    return found.select("doc_id", *base_numbers("base"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; ``n_chars``, if there, follows the text."""
    found = find(docs, key, text).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("__doc"), F.col("fingerprint").alias("__print")).agg(F.min("spans").alias("__spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = F.coalesce(F.col(text), F.lit(""))

    def put(spans: Column, far: Column) -> Column:
        """The text between spans and the spans' names; a span that begins inside an earlier one is part of it. ``far``: the furthest end so far."""
        own = F.transform(spans, lambda s, k: F.struct(F.when(k > 0, F.get(far, k - 1)).otherwise(0).alias("before"), s["start"].alias("start"), s["kind"].alias("kind")))

        def of_run(run: Column) -> Column:
            begin = run[0]["before"]
            part = F.substring(t, begin + 1, F.element_at(run, -1)["start"] - begin)
            return bound(part, lambda part: F.array_join(F.transform(run, lambda x: F.concat(F.substring(part, x["before"] - begin + 1, x["start"] - x["before"]), F.get(names, x["kind"]))), ""))

        pieces = bound(F.filter(own, lambda x: x["start"] >= x["before"]), lambda own: F.transform(in_runs(own), of_run))
        return F.concat(F.array_join(pieces, ""), F.substring(t, F.element_at(far, -1) + 1, F.length(t)))

    done = bound(F.struct(F.col("__spans").alias("s"), running(F.transform("__spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("far")), lambda x: put(x["s"], x["far"]))
    rows = docs.withColumn("__fp", F.xxhash64(t)).join(found, same(F.col(key), F.col("__doc")) & (F.col("__fp") == F.col("__print")), "left")
    rows = rows.withColumn(text, F.when(F.col("__spans").isNotNull(), done).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
