"""File attribute words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute bits and their names, ascending (fixed values).
NAMES = {
    0x1: "ReadOnly", 0x2: "Hidden", 0x4: "System", 0x10: "Directory", 0x20: "Archive", 0x40: "Device", 0x80: "Normal",
    0x100: "Temporary", 0x200: "SparseFile", 0x400: "ReparsePoint", 0x800: "Compressed", 0x1000: "Offline",
    0x2000: "NotContentIndexed", 0x4000: "Encrypted", 0x8000: "IntegrityStream", 0x20000: "NoScrubData",
}
#: Offline, recall on open, recall on data access (fixed values).
CLOUD = 0x1000 | 0x40000 | 0x400000
REPARSE = 0x400
#: Reparse tags of junctions and symbolic links (fixed values).
LINK_TAGS = (0xA0000003, 0xA000000C)


def names(word: Column) -> Column:
    """Names by ascending bit; "0" for none; the number itself if a bit has no name."""
    known = sum(NAMES)
    listed = F.concat_ws(", ", *[F.when(word.bitwiseAND(bit) != 0, name) for bit, name in NAMES.items()])
    return F.when(word.isNull(), None).when(word.bitwiseAND(F.bitwise_not(F.lit(known).cast("long"))) != 0, word.cast("string")).when(word == 0, "0").otherwise(listed)


def has_all(word: Column, bits: int) -> Column:
    return word.bitwiseAND(bits) == bits


def is_cloud(word: Column) -> Column:
    return word.bitwiseAND(CLOUD) != 0


def is_true_link(word: Column, tag: Column) -> Column:
    return has_all(word, REPARSE) & F.coalesce(tag.isin(*LINK_TAGS), F.lit(False))
