"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"


def extension(name: Column) -> Column:
    """From the last dot on, with its case; '' without a dot or after a trailing one. A leading dot counts."""
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def suffix(name: Column) -> Column:
    """Lower-cased extension of names that have something before the last dot (``.gitignore`` has none)."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"[\\/]+$", ""))


def sort_key(path: Column) -> Column:
    """Separators sort before everything else."""
    return F.replace(F.lower(F.translate(path, "/", SEP)), F.lit(SEP), F.lit("\x00"))


def parts(path: Column) -> Column:
    return F.split(F.translate(path, "/", SEP), r"\\")


def depth(relative: Column) -> Column:
    return F.size(parts(relative)) - 1


def top_level(relative: Column) -> Column:
    return F.when(depth(relative) == 0, "(root)").otherwise(F.get(parts(relative), F.lit(0)))


def parent(path: Column) -> Column:
    return F.array_join(F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0))), SEP)


def join(root: Column, relative: Column) -> Column:
    return F.concat(F.rtrim(root, F.lit(SEP)), F.lit(SEP), relative)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def walk_key(relative: Column) -> Column:
    """Orders files as a sorted walk meets them: a folder's files, then its folders, each by folded name."""
    p = parts(relative)
    return F.transform(p, lambda x, i: F.struct((i < F.size(p) - 1).cast("int").alias("folder"), F.lower(x).alias("folded"), x.alias("raw")))


def shard_path(digest: Column) -> Column:
    """``ab/cd/<digest>.txt``"""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".txt"))


def long_path(path: Column) -> Column:
    r"""The form that lifts the length limit: ``\\?\C:\x``, ``\\?\UNC\server\share``."""
    return F.when(path.startswith("\\\\?\\"), path).when(path.startswith("\\\\"), F.concat(F.lit("\\\\?\\UNC\\"), F.substring(path, 3, 1 << 30))).otherwise(F.concat(F.lit("\\\\?\\"), path))


def short_path(path: Column) -> Column:
    """Undoes :func:`long_path` in messages; the network form first."""
    return F.replace(F.replace(path, F.lit("\\\\?\\UNC\\"), F.lit("\\\\")), F.lit("\\\\?\\"), F.lit(""))
