"""URL rules as intervals of canonical keys, matched by a sort-merge range join.

The canonical key of a host is its labels in reverse, each with a dot after
it, so a rule's host is a prefix of its own key and of every subdomain's: the
rule is one interval of the sorted keys. Distinct (host, path) pairs and rules
are dealt over ranges of the keys; in each range one sweep keeps the stack of
the hosts whose intervals are open, one inside the other. Each open host holds
its rules' paths in order, every path with the longest shorter one that begins
it, so the longest that fits is found by one search and a walk up that chain.

URLs without ``://`` and null URLs have an empty host and path. Of rules that
fit, the longest (host and path together) wins, of equally long ones that with
the longer host; of equal rules with two verdicts ``block`` holds. Rules with a
null in host, path or verdict count for nothing. Verdicts depend on host and
path alone, so they are worked out once for each distinct pair; a popular
page's rows meet their verdict by a broadcast. Rows with a null key and rows
that repeat are judged each by itself. Other columns, whatever their names,
are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Table, join_popular

#: Keys looked at to choose the borders of the ranges; results don't depend on them.
BORDER_SAMPLE = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.when(at > 0, path).otherwise("")


def host_key(host: Column) -> Column:
    """The labels of a host from last to first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows; a general caller may pass a table of any size to :func:`judge` instead."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _ranges_of(borders: list[tuple[str, str]], key: str) -> range:
    """The ranges that the interval of a host's key meets."""
    first = last = bisect.bisect_right(borders, (key, ""))
    while last < len(borders) and borders[last][0].startswith(key):
        last += 1
    return range(first, last + 1)


class OpenHost:
    """A host on the stack with its rules: paths in order, each with the longest other one that begins it."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.up: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        """Paths come in order."""
        k = len(self.paths) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.up.append(k)

    def longest(self, path: str) -> int:
        k = bisect.bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        return k


def judge(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``df``."""
    spark = df.sparkSession
    host, path = host_and_path(F.col(url))
    base = df.select(F.col(key), host.alias("host"), path.alias("path"))
    ruled = rules.where("host is not null and path is not null and verdict is not null")
    ruled = ruled.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    ruled = Table(ruled.select(host_key(F.col("host")).alias("hkey"), "path", "host", F.lit(0).cast("long").alias("copies"), "verdict"), "rules")
    pairs = base.groupBy("host", "path").agg(F.count("*").alias("copies"))
    points = Table(pairs.select(host_key(F.col("host")).alias("hkey"), "path", "host", "copies", F.lit(None).cast("string").alias("verdict")), "points")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = points.df.orderBy(F.xxhash64("hkey", "path"), "hkey", "path").limit(BORDER_SAMPLE).select("hkey", "path").collect()
    some = sorted(tuple(r) for r in some)
    borders = sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []
    schema = "range int, hkey string, path string, host string, copies long, verdict string"

    def deal(batches):
        for batch in batches:
            at = [bisect.bisect_right(borders, x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    def spread(batches):
        for batch in batches:
            meets = [_ranges_of(borders, x) for x in batch.column(0).to_pylist()]
            rows = pa.array([i for i, m in enumerate(meets) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for m in meets for k in m], pa.int32()), *[c.take(rows) for c in batch.columns]], names=["range", *batch.schema.names])

    def sweep(batches):
        at, open_hosts = None, []  # each inside the one below it
        for batch in batches:
            out = []
            for here, hkey, path, host, copies, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != at:
                    at, open_hosts = here, []
                while open_hosts and not hkey.startswith(open_hosts[-1].key):
                    open_hosts.pop()
                if verdict is not None:
                    if not open_hosts or open_hosts[-1].key != hkey:
                        open_hosts.append(OpenHost(hkey, host))
                    open_hosts[-1].add(path, verdict)
                    continue
                best = None
                for rules_of in open_hosts:
                    k = rules_of.longest(path)
                    if k >= 0:
                        found = (len(rules_of.host) + len(rules_of.paths[k]), len(rules_of.host), rules_of, k)
                        best = found if best is None or found[:2] > best[:2] else best
                rule, said = (best[2].host + best[2].paths[best[3]], best[2].verdicts[best[3]]) if best else (None, None)
                out.append((host, path, copies, rule, said))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "p", "copies", "rule", "said"])

    rows = points.df.mapInArrow(deal, schema).unionByName(ruled.df.mapInArrow(spread, schema))
    # a host's rules come before its pages, and those before its subdomains
    rows = rows.repartition(ranges, "range").sortWithinPartitions("range", "hkey", F.col("verdict").isNull(), "path", "host")
    judged = Table(rows.mapInArrow(sweep, "h string, p string, copies long, rule string, said string"), "judged").df
    ruled.drop()
    points.drop()
    out = join_popular(base, judged, [("host", "h"), ("path", "p")], "copies", nulls=False)
    return out.select(key, "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
