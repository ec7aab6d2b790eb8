"""The ten operators: brute force on small inputs, and the corner cases each docstring defines."""

import hashlib
import math
import random
import struct
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafile.llm import _shared, bpe, covertree, neardup, packing, pii, quality_gam, quality_rules, queries, sharding, urlrules, warc

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path(queries.BYTE_BPE)
ODD = [None, "", " ", "a", "\n\n", "one two three four five", "One two three four five", "word " * 9000, "x" * 60000, "a@b.co " * 300, "é ß 😊 　 \x1c\x85", "<|endoftext|> end  of \n text"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in enumerate(texts, start)], "doc_id long, text string, lang string, source string, n_chars long, kept string")


def table(spark, name):
    return queries.table(spark, SMALL, name)


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    import compare

    compare.same(spark, name, queries.queries()[name], queries.oracle_sql()[name])


# shared


def test_components(spark):
    random.seed(1)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(random.randrange(60), random.randrange(60)) for _ in range(45)]):
        df = spark.createDataFrame(edges, "a long, b long")
        found = {r["node"]: r["component"] for r in _shared.components(df, "a", "b").collect()}
        nodes = {n for e in edges if e[0] != e[1] for n in e}
        assert found == brute.components(nodes, [e for e in edges if e[0] != e[1]])


def test_rank_within(spark):
    df = spark.createDataFrame([(i % 2 if i % 5 else None, i // 3) for i in range(100)], "g int, x int")
    ranks = {}
    for r in _shared.rank_within(df, ["g"], ["x"], "k").collect():
        ranks.setdefault(r["g"], []).append(r["k"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values()) and sum(map(len, ranks.values())) == 100


# 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")


def test_op1_brute_force_and_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 6)), 15, axis=0) + rng.normal(size=(180, 6)) * 0.08
    x[20] = x[21]
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 3), "k") for i in range(180)]
    rows += [(900, None, 0, "k"), (901, [0.0] * 6, 0, "k"), (902, [float("nan")] * 6, 0, "k"), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "k"), (904, rows[0][1], None, "k"), (905, [], 1, "k"), (906, [1.0, 2.0], 1, "k")]
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = [(i, j) for i in range(180) for j in range(180) if i != j and i % 3 == j % 3 and y[i] @ y[j] >= 0.98]
    comp = brute.components(range(180), links)
    for block in (16, 4096):
        found = {r["vec_id"]: r for r in covertree.near_duplicates(vectors(spark, rows), block=block).collect()}
        assert len(found) == 187
        for i in range(180):
            assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (sum(a == i for a, _ in links), comp[i], comp[i] == i)
        assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in range(900, 907))
    assert covertree.near_duplicates(vectors(spark, [])).count() == 0


def test_op1_tree_covers(spark):
    x = np.random.default_rng(2).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x)
    assert sorted(tree.order) == list(range(300))
    for k in range(len(tree.center)):
        own = tree.order[tree.begin[k] : tree.end[k]]
        assert covertree.distances(x[[tree.center[k]]], x[own]).max() <= tree.radius[k] + covertree.SLACK


# 2


def test_op2_held_out_accuracy(spark):
    found = queries.op2_pairwise_gam_quality(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.95 and found["score"].between(0, 1).all()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in found["doc_id"])


def test_op2_held_out_labels_are_not_used(spark):
    d, lab = docs(spark, [f"good text number {i} of words" if i % 3 else "BAD!! " * 20 for i in range(60)]), [(i, int(bool(i % 3)), 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in lab]
    one, two = ({r["doc_id"]: r["score"] for r in quality_gam.classify(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (lab, flipped))
    assert one == two


def test_op2_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_gam.classify(docs(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    lab = spark.createDataFrame([(5, 1), (5, 1), (6, None), (None, 0), (7, 0)], "doc_id long, quality int")
    assert quality_gam.classify(docs(spark, ODD), lab).count() == len(ODD)
    assert quality_gam.accepted(docs(spark, []), lab).count() == 0


# 3


def test_op3_corner_cases(spark):
    rules = urlrules.rule_table(spark, [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("A.ORG", "/x", "allow"), ("b.a.org", "/", "allow"), ("t", "/long", "block"), ("s.t", "/lo", "allow")])
    cases = {
        "http://A.org/x/1": ("a.org", "/x/1", "a.org/x", "block"), "http://c.a.org/x/y?q": ("c.a.org", "/x/y", "a.org/x/y", "allow"), "http://b.a.org/x": ("b.a.org", "/x", "b.a.org/", "allow"),
        "http://org": ("org", "", None, "allow"), "http://xa.org/x": ("xa.org", "/x", "org/", "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "x://s.t/long": ("s.t", "/long", "s.t/lo", "allow"), "a://b://org/": ("b:", "//org/", None, "allow"), "http://Ä.ORG#/x": ("Ä.org", "", None, "allow"), "": ("", "", None, "allow"),
    }
    urls = [*cases, *cases]
    df = spark.createDataFrame([(i if i % 4 else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = urlrules.judge(df, rules).collect()
    assert len(found) == len(urls)
    assert sorted(map(str, ((r["host"], r["path"], r["rule"], r["verdict"]) for r in found))) == sorted(map(str, [cases[u] for u in urls]))
    assert urlrules.judge(df.limit(0), rules).count() == 0 and urlrules.judge(df, rules.limit(0)).where("rule is not null").count() == 0


def test_op3_random_rules(spark):
    random.seed(2)
    host = lambda: ".".join(random.choice("ab") for _ in range(random.randint(1, 3)))
    path = lambda: "/" + "".join(random.choice("xy/") for _ in range(random.randint(0, 4)))
    rules = {(host(), path()): random.choice(["allow", "block"]) for _ in range(25)}
    pages = [(i, f"http://{host()}{path()}") for i in range(400)]
    found = urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), urlrules.rule_table(spark, [(*k, v) for k, v in rules.items()]), default="none")
    for r in found.collect():
        fits = [k for k in rules if (r["host"] == k[0] or r["host"].endswith("." + k[0])) and r["path"].startswith(k[1])]
        best = max(fits, key=lambda k: (len(k[0] + k[1]), len(k[0])), default=None)
        assert (r["rule"], r["verdict"]) == (("".join(best), rules[best]) if best else (None, "none"))


# 4


def check_packing(rows, ids_of):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows) == sum(map(len, ids_of.values()))
    return len(by)


def test_op4_packs_everything_tightly(spark):
    library = Tokenizer.from_file(VOCABULARY)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts_of(spark).items()}
    n = check_packing(queries.op4_best_fit_packing(spark, SMALL).collect(), ids)
    assert n <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.02 + 1


def test_op4_corner_cases(spark):
    library = Tokenizer.from_file(VOCABULARY)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ODD)}
    rows = packing.pack(docs(spark, ODD), VOCABULARY, with_ids=True).collect()
    check_packing(rows, ids)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    for i in ids:
        lengths = [r["length"] for r in sorted(rows, key=lambda r: r["piece"]) if r["doc_id"] == i]
        assert lengths[1:] == [1024] * (len(lengths) - 1)
    twice = docs(spark, ["same"] * 5).withColumn("doc_id", F.lit(None).cast("long"))
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack(twice, VOCABULARY).collect()}) == 5
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_op4_plan_is_whole():
    random.seed(3)
    for capacity in (7, 50):
        histogram = {k: random.randint(1, 40) for k in random.sample(range(1, capacity + 1), 6)}
        bins = {}
        for length, runs in packing.plan(histogram, capacity).items():
            rank = 0
            for first, n, sequence, offset, copies in runs:
                assert first == rank
                rank += n
                for j in range(n):
                    bins.setdefault(sequence + j // copies, []).append((offset + j % copies * length, length))
            assert rank == histogram[length]
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity


# 5


def test_op5_brute_force(spark):
    texts = texts_of(spark)
    trusted = {r["doc_id"] for r in table(spark, "labels").where("quality = 1").collect()}
    ratio = brute.ratios(texts, trusted, quality_rules.PAIR_BUCKETS, quality_rules.LEAST_SEEN, quality_rules.SMOOTHING)
    for r in queries.op5_ngram_ratio_rules(spark, SMALL).collect():
        want = brute.base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        if not r["base_failed"]:
            assert abs(r["ratio"] - ratio[r["doc_id"]]) < 1e-4
            assert r["kept"] == (r["ratio"] >= quality_rules.LEAST_RATIO)
        else:
            assert not r["kept"]


def test_op5_corner_cases(spark):
    odd = [*ODD, "a b c d e f g h i j k a b c d e", "a b c d e a b c d e a b c d e f", "x\n \nx\ny\nx  \nx\n", "1 2 3 4 5 6 7 8 9 10"]
    none = spark.createDataFrame([], "doc_id long")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, odd).drop("kept"), none).collect()}
    for i, t in enumerate(odd):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(t), t
    assert quality_rules.judge(docs(spark, []).drop("kept"), none).count() == 0
    kept = quality_rules.accepted(docs(spark, odd), none)
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_op5_clean_documents_stay(spark):
    found = queries.op5_ngram_ratio_rules(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not base_failed")
    r = found.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r["good"] >= 0.99 and r["bad"] <= 0.3


def test_op5_bad_documents_go_at_any_size(spark):
    shares = []
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        found = queries.op5_ngram_ratio_rules(spark, d).join(queries.table(spark, d, "labels"), "doc_id").where("n_words >= 10")
        shares.append(found.agg(F.avg(F.when(F.col("quality") == 0, (F.col("ratio") >= quality_rules.LEAST_RATIO).cast("int"))).alias("bad"), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good")).first())
    assert shares[1]["bad"] <= shares[0]["bad"] and shares[1]["good"] >= 0.99, shares


def test_op5_weights_met_by_a_shuffle(spark, monkeypatch):
    texts = texts_of(spark)
    trusted = table(spark, "labels").where("quality = 1")
    monkeypatch.setattr(quality_rules, "HEAD_ROWS", 500)
    ratio = brute.ratios(texts, {r["doc_id"] for r in trusted.collect()}, quality_rules.PAIR_BUCKETS, quality_rules.LEAST_SEEN, quality_rules.SMOOTHING)
    for r in quality_rules.judge(table(spark, "documents"), trusted).where("not base_failed").collect():
        assert abs(r["ratio"] - ratio[r["doc_id"]]) < 1e-4


# 6


def test_op6_equals_the_library(spark):
    random.seed(3)
    letters = ["a", "b", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "1", "²", "!", "'s", "'ll", ".", ",", "word,", " The", "<|endoftext|>", "😊", "́", "Ⅷ", "\x00", "﻿"]
    texts = ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    library = Tokenizer.from_file(VOCABULARY)
    for backend in ("queue", "library"):
        found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(spark, texts), VOCABULARY, backend=backend), VOCABULARY).collect()}
        for i, t in enumerate(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert list(struct.unpack(f"<{found[i]['n_tokens']}I", found[i]["ids"])) == ids, repr(t)
            assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_op6_round_trip(spark):
    texts = texts_of(spark)
    for r in queries.op6_bpe_round_trip(spark, SMALL).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, []), VOCABULARY).count() == 0


# 7


def test_op7_corner_cases(spark):
    base = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join("EDIT" + str(i) if i in at else w for i, w in enumerate(base))
    texts = [*ODD, edit(), edit(30), edit(5, 55), edit(3, 20, 40), edit().upper(), "w1 w2", "W1\tw2", *[edit(k) for k in range(0, 60, 3)]]
    want = brute.near_duplicates(dict(enumerate(texts)))
    found = neardup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    nobody = neardup.near_duplicates(docs(spark, [edit(), edit()]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nobody) == 2 and all(r["component_id"] is None and r["kept"] for r in nobody)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert {r["doc_id"] for r in neardup.keep_one(docs(spark, texts)).collect()} == {d for d, (_, c) in want.items() if c == d}


def test_op7_large_groups_over_several_blocks(spark, monkeypatch):
    random.seed(7)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"x{random.random()}" if i in at else w for i, w in enumerate(base)) for at in [random.sample(range(100), random.choice([0, 1, 2, 3, 4])) for _ in range(150)]]
    monkeypatch.setattr(neardup, "BLOCK", 40)
    want = brute.near_duplicates(dict(enumerate(texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts)).collect()} == want


def test_op7_sketches():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    a, b = neardup.mix(a), neardup.mix(b)
    bits = lambda x, y: int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
    differ = bits(neardup.odd_sketch(neardup.samples(a)), neardup.odd_sketch(neardup.samples(b)))
    assert abs(neardup.estimate(differ) - 900 / 1100) < 0.15 and differ <= neardup.FAR_BITS
    assert 150 <= bits(neardup.fine_sketch(a), neardup.fine_sketch(b)) <= 200


# 8


def test_op8_archives(spark, tmp_path):
    long_ = "<p>" + "ünïcode " * 40000
    html = ["x" * 99, "x" * 99, "y" * 100, "y" * 100, None, "", long_, long_, "tail\r\n\r\nWARC/1.1\r\n", long_ + "."]
    df = spark.createDataFrame([(i if i != 3 else None, f"http://h/{i} \r\n", h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, record_type string")
    manifest = warc.write(df, str(tmp_path), chunk=1000, file_bytes=100_000)
    rows = warc.read(manifest, chunk=1000).collect()
    ends = {r["key"]: r for r in rows if r["is_last"]}
    assert len([r for r in rows if r["is_last"]]) == len(html) and max(len(r["chunk"]) for r in rows) <= 1000
    for i, h in enumerate(html):
        data, r = (h or "").encode(), ends[i if i != 3 else None]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        first = {3: 2, 7: 6}.get(i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first is not None else ("response", None))
        if first is None:
            mine = sorted((x for x in rows if x["key"] == r["key"]), key=lambda x: x["chunk_no"])
            assert b"".join(bytes(x["chunk"]) for x in mine) == data and [x["chunk_no"] for x in mine] == list(range(len(mine)))
            assert all(x["payload_digest"] == hashlib.sha256(data[: x["payload_bytes"]]).hexdigest() for x in mine)
    assert warc.read(warc.write(df.limit(0), str(tmp_path))).count() == 0


def test_op8_damage_is_found():
    import io

    body = b"payload"
    whole = warc.warc_header(1, None, "response", None, len(body), hashlib.sha256(body).hexdigest()) + body + b"\r\n\r\n"
    assert len(list(warc.parse(io.BytesIO(whole * 2)))) == 2
    for broken in (whole[:-6], whole.replace(b"payload", b"paXload")):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(broken)))


# 9


def test_op9_shards(spark):
    rows = queries.op9_weighted_tree_sharding(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.4 * min(map(len, by.values())) and any(r["grown_shard"] == 8 for r in rows)


def test_op9_weights_and_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "k")
    tree = sharding.Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 2.0),))))
    share = {r["s"]: r["count"] / 20000 for r in ids.groupBy(sharding.place(tree, F.col("k")).alias("s")).count().collect()}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    grown = tree.grow().grow()
    moved = ids.select(sharding.place(tree.grow(), F.col("k")).alias("a"), sharding.place(grown, F.col("k")).alias("b")).where("a <> b").select("b").distinct().collect()
    assert [r["b"] for r in moved] == [5]


def test_op9_corner_cases(spark):
    texts = ODD + ["same", "same"]
    rows = sharding.shard(docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id") % 5))).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(texts) and sharding.shard(docs(spark, [])).count() == 0


# 10

PERSONAL = [
    "a@b.co, x.y+z@q-r.example.org. a@b@c.de a@b.c_d@e.f @x.y a@.b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 9999999999.1.1.1 1.2.3.", "4111 1111 1111 1111 4111-1111-1111-1112 49927398716 12345678901234567890",
    "+1 (437) 555-0689, +12345678901234567 +1-2 ++44 20 7946 0958. +1", "😊é a@b.co ß 10.0.0.1 😊", "nothing here", None, "", "1" * 5000, "a" * 50000 + "@", "a." * 3000 + "@b" + ".c" * 3000,
]


def test_op10_base_spans(spark):
    random.seed(6)
    letters = ["a", "@", ".", "b", "1", "25", "255", "0", " ", "-", "+", "(", "4111", "_", "é"]
    texts = PERSONAL + ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) for _ in range(1500)]
    found = {r["doc_id"]: r for r in pii.report(pii.find(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute.personal(t)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), repr(t)
        assert [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[1] == k for x in want) for k in ("email", "ip", "card", "phone")]
    assert pii.report(pii.find(docs(spark, []))).count() == 0


def test_op10_finds_unseen_identifiers(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f"some words then member id: {key(i)} and more" for i in range(12)] + ["words then member id: QX-77-90417 and more", "the year 1984-2024 was id free", "room 20240101 of the hotel"]
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(docs(spark, texts))).collect()}
    at = texts[12].index("QX")
    assert found[12] == f"context:{at}:{at + len('QX-77-90417')}" and found[13] == "" and found[14] == ""


def test_op10_phones_do_not_vouch_for_numbers_after_numbers(spark):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    clean = ["see page 12 20240101 of it", "table 7 1984-2024 was free", "12 20240102 begins a text"]
    texts = [f"so {letters(i)} said {letters(i + 7)} +1 ({i + 100}) 555-{i + 1000} then" for i in range(40)] + clean
    found = {r["doc_id"]: r for r in pii.report(pii.find(docs(spark, texts))).collect()}
    assert all(found[i]["n_phone"] == 1 and found[i]["spans"].startswith("phone:") and "," not in found[i]["spans"] for i in range(40))
    assert [found[40 + i]["spans"] for i in range(len(clean))] == [""] * len(clean)


def test_op10_wide_spans_are_seeds(spark):
    texts = [f"you may call me: +1 ({i + 100}) 555-{i + 1000} then" for i in range(12)] + ["you may call me: QX-77-90417 then", "card 4111 1111 1111 1111 end"]
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(docs(spark, texts))).collect()}
    at = texts[12].index("QX")
    assert found[12] == f"context:{at}:{at + len('QX-77-90417')}" and found[13] == "card:5:24"


def test_op10_contexts_of_any_length(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    far = "https://example.org/" + "path/" * 30
    texts = [f"member {far} {key(i)} and more" for i in range(12)] + [f"member {far} QX-77-90417 and more", "member" + " " * 200 + far + " " * 200 + "QX-77-90418 and more"]
    found = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(docs(spark, texts))).collect()}
    for i in (12, 13):
        at = texts[i].index("QX")
        assert found[i] == f"context:{at}:{at + len('QX-77-90417')}"


def test_op10_redaction(spark):
    df = docs(spark, ["mail a@b.co or 10.0.0.1 now", None, "clean", "😊a@b.co"])
    found = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert [found[i]["text"] for i in range(4)] == ["mail <EMAIL> or <IP> now", None, "clean", "😊<EMAIL>"]
    assert found[0]["n_chars"] == len(found[0]["text"]) and found[2]["n_chars"] == 1 and pii.redact(df).columns == df.columns
