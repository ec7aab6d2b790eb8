"""The tables of the test corpus seen as files under four source roots.

Metadata (:func:`files`) and bodies (:func:`bodies`) are separate frames, so a
body is only joined to rows whose digest is wanted. Everything is a function
of the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, paths

#: root_id, path
ROOTS = ((1, r"C:\Corpus\Docs"), (2, r"C:\Corpus\Mirror"), (3, r"D:\Web"), (4, r"D:\Chat"))
#: Root ordinals by path key.
ORDINALS = {r: k for k, (_, r) in enumerate(sorted((p.lower(), r) for r, p in ROOTS), 1)}
BILLION = 1_000_000_000
WORDS = (32, 33, 34, 4128, 4194336, 128)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p, ORDINALS[r]) for r, p in ROOTS], "root_id int, root_path string, root_ordinal int")


def pick(key: Column, values: tuple) -> Column:
    out = F.lit(values[-1])
    for k in range(len(values) - 2, -1, -1):
        out = F.when(key % len(values) == k, values[k]).otherwise(out)
    return out


def document_name(key: Column) -> Column:
    stem = F.concat(F.lit("doc"), key.cast("string"))
    ends = pick(key, (".md", ".TXT", ".log", "", ".", "", ".tar.gz", ".txt"))
    return F.concat(F.when(key % 8 == 5, ".").otherwise(""), stem, ends)


def _root(spark: SparkSession, sf_dir: str, root: int) -> DataFrame:
    """(root_id, file_id, relative_path, attribute_word, volume_serial, file_index, minutes, inaccessible, text)"""
    s = lambda c: c.cast("string")
    if root in (1, 2):
        d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
        k = F.col("doc_id")
        unknown = k % 13 == 0
        if root == 1:
            path = F.concat_ws(paths.SEP, "source", "lang", document_name(k))
            index, word, lost = F.when(~unknown, s(k)), pick(k, WORDS), k % 97 == 0
        else:
            d = d.where("doc_id % 5 = 0")
            path = F.concat_ws(paths.SEP, "lang", document_name(k))
            index = F.when(k % 10 != 0, s(k + BILLION)).when(~unknown, s(k))
            word, lost = F.lit(32), F.lit(False)
        volume, file_id, minutes, body = F.when(index.isNotNull(), "1"), k + (root - 1) * BILLION, k, F.col("text")
    elif root == 3:
        d = read(spark, sf_dir, "pages").select("page_id", "html")
        k = F.col("page_id")
        file_id, path, body = k + 2 * BILLION, F.concat(F.lit("page_"), s(k), F.lit(".html")), F.col("html")
        volume, index, word, lost, minutes = F.lit("2"), s(file_id), F.lit(32), F.lit(False), k
    else:
        d = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
        file_id = F.col("conv_id") * 1000 + F.col("turn") + 3 * BILLION
        path = F.concat(F.col("role"), F.lit("\\c"), s(F.col("conv_id")), F.lit("_"), s(F.col("turn")), F.lit(".txt"))
        volume, index, word, lost, minutes, body = F.lit("2"), s(file_id), F.lit(32), F.lit(False), F.col("turn"), F.col("text")
    return d.select(
        F.lit(root).alias("root_id"), file_id.alias("file_id"), path.alias("relative_path"), word.cast("long").alias("attribute_word"),
        volume.alias("volume_serial"), index.alias("file_index"), minutes.cast("long").alias("minutes"), lost.alias("inaccessible"), body.alias("text"),
    )


def raw(spark: SparkSession, sf_dir: str, only: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    out = None
    for root in only:
        part = _root(spark, sf_dir, root)
        out = part if out is None else out.unionByName(part)
    return out


def described(rows: DataFrame) -> DataFrame:
    """Inventory records of :func:`raw` rows; the body only gives its length."""
    name = F.substring_index("relative_path", paths.SEP, -1)
    ordinal = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    lost = F.col("inaccessible")
    return rows.select(
        "root_id", ordinal[F.col("root_id")].alias("root_ordinal"), "file_id", "relative_path", name.alias("file_name"), paths.extension(name).alias("extension"),
        F.when(~lost, F.octet_length("text").cast("long")).alias("size_bytes"), F.timestamp_seconds(F.lit(1704067200) + F.col("minutes") * 60).alias("modified_utc"),
        "attribute_word", attrs.names(F.col("attribute_word")).alias("attributes"), attrs.is_cloud(F.col("attribute_word")).alias("is_offline_or_cloud"),
        paths.depth(F.col("relative_path")).alias("depth"), paths.sort_key(F.col("relative_path")).alias("path_sort_key"),
        "volume_serial", "file_index", F.when(lost, "inaccessible").otherwise("observed").alias("status"),
    )


def files(spark: SparkSession, sf_dir: str, only: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    return described(raw(spark, sf_dir, only))


def bodies(spark: SparkSession, sf_dir: str, only: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(file_id, content) of the files that can be read."""
    return raw(spark, sf_dir, only).where(~F.col("inaccessible")).select("file_id", F.encode("text", "UTF-8").alias("content"))
