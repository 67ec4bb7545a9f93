"""Text functions as column expressions (TXT1-TXT13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "<.*?>"
BREAKS = "[\\r\\n\\t]+"
# fixed values: the signs that part words, and the shape of an indexed word
SIGNS = "[.,:;!?'\"()-]+"
WORD = "^[a-zA-Z0-9]+$"


def lines(text: Column) -> Column:
    """The lines of a text (TXT1)."""
    return F.split(text, "\n")


def strip_line_tags(text: Column) -> Column:
    """Tags that open and close on one line become a space (TXT2)."""
    return F.regexp_replace(text, TAG, " ")


def raw_tokens(text: Column) -> Column:
    """White-space runs of the lower-cased text without tags and signs, empty ones left out (TXT2-TXT5)."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(strip_line_tags(text)), BREAKS, " "), SIGNS, " ")
    return F.filter(F.split(clean, "\\s+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    """The indexed words of a text in order: letters and digits of ASCII alone (TXT6)."""
    return F.filter(raw_tokens(text), lambda t: t.rlike(WORD))


def ascii_only(text: Column) -> Column:
    """The text without characters beyond ASCII (TXT9)."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def query_words(query: Column) -> Column:
    """The distinct words of a query in order (TXT10-TXT12)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), "\\p{Punct}", " "), "\\s+", " "))
    return F.array_distinct(F.filter(F.split(clean, " "), lambda t: t != ""))


def replace_last_word(query: Column, word: Column) -> Column:
    """The query with its last word replaced (TXT13)."""
    parts = F.split(F.trim(query), " +")
    return F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(word)), " ")


def posting_text(url: Column, positions: Column) -> Column:
    """``url:p1 p2 ...`` (TXT7)."""
    return F.concat(url, F.lit(":"), F.array_join(F.transform(positions, lambda p: p.cast("string")), " "))


def posting_parts(text: Column) -> Column:
    """``(url, positions)`` of a posting's text, parted at its last colon (TXT7, TXT8)."""
    url = F.regexp_extract(text, "^(.*):[^:]*$", 1)
    positions = F.transform(F.split(F.regexp_extract(text, ":([^:]*)$", 1), " "), lambda p: p.cast("int"))
    return F.struct(url.alias("url"), positions.alias("positions"))
