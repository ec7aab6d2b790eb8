"""Clocks: local times of a named zone, tolerant parsing, the order of a date's parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .render import FILE_TIME_ZERO

#: Forms of timestamps that runs have written (fixed values).
UTC_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd")


def seconds_of(ns: Column) -> Column:
    """Whole seconds of nanoseconds, rounded down."""
    return F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")


def local_clock(ns: Column, zone: str) -> Column:
    """The wall clock of a zone, with the summer time in force at that instant; year 1 for the zero of file times and before."""
    s = seconds_of(ns)
    wall = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(s), zone), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(s <= FILE_TIME_ZERO, "0001-01-01T00:00:00").otherwise(wall)


def offset_minutes(ns: Column, zone: str) -> Column:
    """Minutes east of UTC in a zone at an instant; null where there is no instant, as zero is an offset."""
    s = seconds_of(ns)
    moved = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone)) - s
    return F.when(s > FILE_TIME_ZERO, F.floor(moved / 60).cast("int"))


def utc_or_null(text: Column) -> Column:
    """A timestamp that was written as UTC or with an offset; null for anything else, never an error. Without an offset it is UTC."""
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in UTC_FORMS])


def date_order(probe: Column) -> Column:
    """MDY or DMY from how a machine writes the 14th of August; ``ambiguous`` if its first number is neither."""
    first = F.regexp_extract(probe, r"^[^0-9]*([0-9]+)", 1).try_cast("int")
    return F.when(first == 14, "DMY").when(first == 8, "MDY").otherwise("ambiguous")


def log_line(at: Column, level: Column, stage: Column, message: Column) -> Column:
    """Time in UTC with milliseconds, level, stage in brackets and the message, in columns and on one line."""
    where = F.coalesce(F.concat(F.lit("["), stage, F.lit("]")), F.lit(""))
    return F.format_string("%s  %-8s %-26s %s", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.upper(level), where, F.trim(F.regexp_replace(message, r"\s+", " ")))


def script_version(header: Column) -> Column:
    """The version that a script's header names; null without one."""
    return F.nullif(F.regexp_extract(F.substring(header, 1, 4000), r"(?md)^\s*Version:\s*(\S+)", 1), F.lit(""))


def share_of_drive(used: Column, total: Column) -> Column:
    """Per cent of a drive with two decimals; null for a drive of no size."""
    return F.when(total > 0, F.round((100 * used / total).cast("decimal(30,10)"), 2).cast("decimal(10,2)"))
