"""HTML functions as column expressions (HTM1-HTM14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.functions import urls
from webrank.functions.text import ascii_only

# fixed values: elements removed whole, and the pattern of links
ELEMENTS = ("style", "script", "footer", "nav")
EARLY_ELEMENTS = ("style", "script", "footer")
HREF = '(?i)<a\\s+[^>]*href\\s*=\\s*"([^"]*)"[^>]*>'
HEAD_CHARS = 1000
PAGE_CHARS = 40_000


def remove_elements(html: Column, elements: tuple[str, ...] = ELEMENTS) -> Column:
    """The document without these elements and what is in them, at any length (HTM1)."""
    for name in elements:
        html = F.regexp_replace(html, f"(?s)<{name}[^>]*>.*?</{name}>", "")
    return html


def hrefs(html: Column) -> Column:
    """The double-quoted targets of all anchors, in order, duplicates kept (HTM2)."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def links(html: Column, base: Column, strict: bool = False) -> Column:
    """The normalised targets of all anchors; those that lead to no page are left out (HTM2)."""
    return F.filter(F.transform(hrefs(html), lambda h: urls.normalise(h, base, strict=strict)), lambda u: u.isNotNull())


def link_rows(pages: DataFrame, html: str, base: str, fragment_is_self: bool = False, strict: bool = False) -> DataFrame:
    """``(src, dst)``: a row for each link of each page that leads to one (HTM2, URL2). Links are parted once, not once per use."""
    found = pages.select(F.col(base).alias("src"), urls.plain_parts(F.col(base)).alias("root"), F.explode(hrefs(F.col(html))).alias("href"))
    if strict:
        dst = urls.strict_absolute(F.col("href"), F.col("src"), fragment_is_self)
    else:
        found = found.withColumn("own", urls.plain_parts(F.col("href")))
        dst = urls.absolute(F.col("href"), F.col("own"), F.col("src"), F.col("root"), fragment_is_self)
    return found.select("src", dst.alias("dst")).where("dst is not null")


def plausible_links(found: Column) -> Column:
    """Links of a fair length, without double dots or an address inside (HTM3)."""
    return F.filter(found, lambda u: (F.length(u) > 13) & (F.length(u) < 150) & ~u.contains("..") & (F.length(u) - F.length(F.regexp_replace(u, "http", "")) == 4) & u.startswith("http"))


def drop_dotted_anchors(html: Column) -> Column:
    """Anchors of dots alone removed (HTM4)."""
    return F.regexp_replace(html, "<a[.]{2,}>", "")


def strip_tags(html: Column) -> Column:
    """All tags removed but those that start with ``a`` (HTM5)."""
    return F.regexp_replace(html, "<[^a]([^>]*)>", "")


def collapse(text: Column) -> Column:
    """Every carriage return and line feed made a line feed, runs of white space a space, ends up to U+0020 trimmed (HTM6)."""
    runs = F.regexp_replace(F.regexp_replace(text, "[\\r\\n]", "\n"), "[ \\t\\n\\x0B\\f\\r]{2,}", " ")
    return F.regexp_replace(runs, "^[\\x00-\\x20]+|[\\x00-\\x20]+\\z", "")


def truncate(text: Column, chars: int = PAGE_CHARS) -> Column:
    """The first ``chars`` characters (HTM7)."""
    return F.substring(text, 1, chars)


def is_english(html: Column, anywhere: bool = False) -> Column:
    """Whether the document says so, near its start or anywhere (HTM8)."""
    return html.contains('lang="en') if anywhere else F.lower(F.substring(html, 1, HEAD_CHARS)).contains('lang="en')


def is_utf8(html: Column) -> Column:
    """Whether the document says so near its start (HTM9)."""
    return F.lower(F.substring(html, 1, HEAD_CHARS)).contains('charset="utf-8"')


def long_enough(html: Column, chars: int = 1000) -> Column:
    """Whether there is enough of it (HTM10)."""
    return F.length(html) >= chars


def is_html(content_type: Column) -> Column:
    """Whether a content type is HTML's (HTM11)."""
    return content_type.startswith("text/html")


def title(html: Column, url: Column) -> Column:
    """The title in ASCII, or host and path where there is none (HTM12)."""
    own = F.trim(ascii_only(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))
    p = urls.parts(url)
    return F.coalesce(F.nullif(own, F.lit("")), F.concat(p["host"], p["path"]))


def paragraphs(html: Column) -> Column:
    """The texts of all paragraphs, tags removed (HTM13)."""
    found = F.regexp_extract_all(html, F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)(?:</p>|(?=<p[\\s>])|$)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def description(html: Column, words: Column) -> Column:
    """The described content, else the paragraph that most query words name first, else the first paragraph, else "" (HTM13, TOP7, AGG13).

    Each word votes for the first paragraph that holds it, whatever the case; the earliest of the most voted wins.
    """
    own = F.regexp_extract(html, '(?is)<meta\\s+name="description"\\s+content="([^"]*)"', 1)
    texts = paragraphs(html)
    votes = F.transform(words, lambda w: F.coalesce(F.array_position(F.transform(texts, lambda t: F.contains(F.lower(t), F.lower(w))), True), F.lit(0)))
    index = F.sequence(F.lit(1), F.greatest(F.size(texts), F.lit(1)))
    counts = F.transform(index, lambda i: F.struct(F.size(F.filter(votes, lambda v: v == i)).alias("n"), (-i).alias("i")))
    best = -F.array_max(counts)["i"]
    return ascii_only(F.coalesce(F.nullif(own, F.lit("")), F.get(texts, (best - 1).cast("int")), F.lit("")))


def line_links(page: Column) -> Column:
    """For each line the first quoted ``href``, either quote, without double dots, each target once (HTM14, SET4)."""
    found = F.transform(F.split(page, "\n"), lambda x: F.regexp_extract(x, "href=[\"']([^\"' ]*)[\"']", 1))
    return F.array_distinct(F.filter(found, lambda u: (u != "") & ~u.contains("..")))
