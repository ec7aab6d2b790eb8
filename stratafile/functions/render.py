"""Cells of reports and exports: times, sizes, numbers, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the zero of Windows file times (fixed value).
FILE_TIME_ZERO = -11_644_473_600
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def iso_from_ns(ns: Column) -> Column:
    """Whole seconds, rounded down; the zero of file times is year 1."""
    seconds = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    return F.when(seconds == FILE_TIME_ZERO, "0001-01-01T00:00:00Z").otherwise(iso(F.timestamp_seconds(seconds)))


def canonical_time(utc: Column, local: Column) -> Column:
    """UTC if known, else the local clock and a word that says so, else nothing."""
    return F.coalesce(iso(utc), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" (local)")), F.lit(""))


def locale_time(ts: Column, order: str) -> Column:
    form = {"MDY": "M/d/yyyy h:mm:ss a", "DMY": "d/M/yyyy h:mm:ss a"}.get(order)
    return F.date_format(ts, form) if form else F.lit(None).cast("string")


def flag(x: Column) -> Column:
    return F.when(x, "True").when(~x, "False")


def duration(seconds: Column) -> Column:
    return F.format_string("%.6f", seconds)


def human_bytes(n: Column) -> Column:
    """1024-based, two decimals rounded half up, thousands marked."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.concat(F.format_number(F.round((n / F.lit(1024.0**4)).cast("decimal(30,10)"), 2), 2), F.lit(" TB"))
    for k in (3, 2, 1, 0):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_number(F.round((n / F.lit(float(1024**k))).cast("decimal(30,10)"), 2), 2), F.lit(f" {units[k]}"))).otherwise(out)
    return out


def fixed(x: Column, places: int) -> Column:
    """A double as C prints it: its binary value to the nearest, exact ties to even. ``format_string`` rounds the shortest decimal half up instead.

    Digits beyond the shortest decimal (about 16 in all) are zeros.
    """
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def half_even(x: Column, places: int = 1) -> Column:
    return F.bround(x.cast("decimal(30,10)"), places)


def estimate_text(seconds: Column) -> Column:
    minutes = F.ceil(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(seconds < 60, "under a minute").when(minutes < 60, F.format_string("~%d min", minutes)).when(rest == 0, F.format_string("~%d hr", hours)).otherwise(F.format_string("~%d hr %d min", hours, rest))
