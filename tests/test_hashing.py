"""The selective ladder against a plain-Python model, and its corner cases."""

import hashlib
import random

from pyspark.sql import functions as F

from stratafile.operators import hashing

SCHEMA = "file_id long, root_id int, relative_path string, attribute_word long, volume_serial string, file_index string, minutes long, inaccessible boolean, text string"


def rows(spark, texts, clouds=()):
    data = [(i, 1, f"d{i % 3}\\f{i:03}", 4128 if i in clouds else 32, None, None, 0, False, t) for i, t in enumerate(texts)]
    return hashing.entries(spark.createDataFrame(data, SCHEMA))


def model(texts, window, clouds=()):
    sha = lambda b: hashlib.sha256(b).hexdigest().upper()
    order = sorted((i for i in range(len(texts)) if i not in clouds), key=lambda i: (f"d{i % 3}\x00f{i:03}", i))
    data = [t.encode() for t in texts]
    sizes = {}
    for i in order:
        sizes.setdefault(len(data[i]), []).append(i)
    multi = [(s, m) for s, m in sizes.items() if len(m) > 1]
    multi.sort(key=lambda x: -x[0] * (len(x[1]) - 1))
    seq = [(g, i) for g, (_, m) in enumerate(multi, 1) for i in m]
    seq.sort(key=lambda x: (x[0], (f"d{x[1] % 3}", f"f{x[1]:03}")))
    out = {i: ["SkippedCloudOnly" if i in clouds else "UniqueBySize", None, None, None] for i in range(len(texts))}
    buckets, group = {}, 0
    for g, i in seq:
        buckets.setdefault((g, sha(data[i][:window])), []).append(i)
    settled, deep = [], []
    for (g, _), m in buckets.items():
        if len(m) == 1:
            out[m[0]] = ["RuledOutByPartialHash", g, None, None]
            continue
        group += 1
        for i in m:
            out[i] = [None, g, group, None]
        (settled if len(data[m[0]]) <= window else deep).append(m)
    dup = 0
    for m in settled:
        dup += 1
        for i in m:
            out[i][0], out[i][3] = "ConfirmedDuplicate", dup
    subs = {}
    for g, i in seq:
        if any(i in m for m in deep):
            subs.setdefault((out[i][2], sha(data[i])), []).append(i)
    for m in subs.values():
        if len(m) > 1:
            dup += 1
        for i in m:
            out[i][0], out[i][3] = ("ConfirmedDuplicate", dup) if len(m) > 1 else ("RuledOutByFullHash", None)
    return out


def result(df):
    return {r["file_id"]: [r["final_status"], r["size_group_id"], r["partial_group_id"], r["duplicate_group_id"]] for r in df.collect()}


def test_ladder(spark):
    texts = ["solo-size!!!!", "aaaa", "bbbb", "12345678-tail1", "12345678-tail2", "12345678-tail1", "", "", "cc", "cc", "cloudy", "cloudy"]
    assert result(hashing.selective(rows(spark, texts, {10}), 8)) == model(texts, 8, {10})


def test_random_against_model(spark):
    random.seed(4)
    for _ in range(4):
        texts = ["".join(random.choice("ab") for _ in range(random.choice([0, 1, 3, 9, 12]))) for _ in range(60)]
        clouds = set(random.sample(range(60), 5))
        found = hashing.selective(rows(spark, texts, clouds).repartition(5), 8)
        assert result(found) == model(texts, 8, clouds)


def test_partial_digest_is_identity_only_if_it_covers_the_file(spark):
    df = spark.createDataFrame([("F", "P", 10), (None, "P", 10), (None, "P", 99), (None, None, 1)], "f string, p string, s long")
    sha, source = hashing.identity(F.col("f"), F.col("p"), F.col("s"), 64)
    assert [tuple(r) for r in df.select(sha, source).collect()] == [("F", "full_hash"), ("P", "partial_hash_complete"), (None, None), (None, None)]
