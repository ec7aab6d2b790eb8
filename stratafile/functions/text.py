"""Text statistics, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends besides CR LF (fixed values).
BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def line_count(text: Column) -> Column:
    """Lines as a splitter at all line ends counts them; no empty last line."""
    tail = F.when((text != "") & ~text.rlike(BREAKS + r"\z"), 1).otherwise(0)
    return F.regexp_count(text, F.lit(r"\r\n|" + BREAKS)) + tail


#: White space of every kind; white space that ends no line; a heading's marks after any indent (fixed values).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
INSIDE = r"[\t\x1f\p{Zs}]"
HEADING = rf"(?:\A|(?<={BREAKS})){INSIDE}*+#{{1,6}}{INSIDE}"


def headings(text: Column) -> Column:
    """Lines that begin, after any indent, with one to six marks and white space."""
    return F.regexp_count(text, F.lit(HEADING))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def front_title(text: Column) -> Column:
    """The title that the front matter gives, '' without one."""
    end = F.locate("\n---", text, 4)
    matter = F.when(text.startswith("---") & (end > 0), F.substring(text, F.lit(4), end - 4)).otherwise("")
    said = trimmed(F.regexp_extract(matter, rf"(?md)^title:{SPACE}*(.+)$", 1))
    return F.regexp_replace(F.regexp_replace(said, r'\A"+|"+\z', ""), r"\A'+|'+\z", "")


def first_title(text: Column) -> Column:
    """The title of the front matter, else that of the first heading of level one, else null."""
    heading = trimmed(F.regexp_extract(text, rf"(?md)^#{SPACE}+(.+)$", 1))
    return F.coalesce(F.nullif(front_title(text), F.lit("")), F.nullif(heading, F.lit("")))


def wiki_links(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?d)\[\[.*?\]\]"))


def inline_tags(text: Column) -> Column:
    """All tags outside heading lines, repeated ones too; a tag is a mark with a letter after it."""
    rest = F.regexp_replace(text, HEADING + "[^" + BREAKS[1:-1] + "]*", "")
    return F.regexp_count(rest, F.lit("#[A-Za-z]"))


def has_front_matter(text: Column) -> Column:
    return text.startswith("---")


def words_or_null(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def int_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("long")


def float_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("double")
