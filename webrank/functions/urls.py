"""URL functions as column expressions (URL1-URL6, HSH1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: link targets that are no pages
BAD_EXTENSIONS = ["jpg", "jpeg", "gif", "png", "txt"]
PARTS = "^(?:([^:/?#]+):)?(?://([^/:]*)(?::([0-9]*))?)?(.*)$"


def parts(url: Column) -> Column:
    """``(scheme, host, port, path)``, absent ones null; without ``//`` all but the scheme is path (URL1)."""
    has = url.contains("//")

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(url, PARTS, i), F.lit(""))

    return F.struct(
        F.when(has, group(1)).alias("scheme"),
        F.when(has, group(2)).alias("host"),
        F.when(has, group(3)).alias("port"),
        F.when(has, group(4)).otherwise(url).alias("path"),
    )


def default_port(scheme: Column) -> Column:
    """The port a scheme stands for."""
    return F.when(scheme == "https", "443").otherwise("80")


def resolve_path(path: Column) -> Column:
    """The path with ``..`` taken back and ``.`` dropped; above the root nothing is taken back."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 20)
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(segments, none, step), "/"))


def seed(url: Column) -> Column:
    """A start URL without fragment, with scheme, port and path filled in (URL3)."""
    bare = F.trim(F.regexp_replace(url, "#.*$", ""))
    full = F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("http://"), bare))
    p = parts(full)
    scheme = F.lower(p["scheme"])
    return F.concat(scheme, F.lit("://"), F.lower(p["host"]), F.lit(":"), F.coalesce(p["port"], default_port(scheme)), F.coalesce(F.nullif(p["path"], F.lit("")), F.lit("/")))


def plain_parts(url: Column) -> Column:
    """``(scheme, host, port, path)`` the plain way: a scheme is what stands before a ``://`` not at the very beginning, absent
    parts are null, and a URL without a scheme is all path (URL1 as the link normaliser reads it)."""
    has = url.contains("//") & ~url.startswith("//")
    after = F.regexp_extract(url, "(?s)^.*?.//(.*)$", 1)
    authority = F.regexp_extract(after, "^([^/]*)", 1)
    ported = authority.rlike("^[^:]+:")
    path = F.regexp_extract(after, "(?s)^[^/]*(/.*)$", 1)
    return F.struct(
        F.when(has, F.regexp_extract(url, "(?s)^(.*?).//", 1)).alias("scheme"),
        F.when(has, F.when(ported, F.substring_index(authority, ":", 1)).otherwise(authority)).alias("host"),
        F.when(has & ported, F.regexp_extract(authority, "^[^:]+:(.*)$", 1)).alias("port"),
        F.when(has, F.when(path == "", "/").otherwise(path)).otherwise(url).alias("path"),
    )


def joined_path(path: Column, base_path: Column) -> Column:
    """A relative path on the directory of ``base_path``: ``..`` takes a segment back as long as there is one, empty segments and
    the slash at the end go, ``.`` stays; nothing left gives the empty path."""
    named = F.split(F.regexp_replace(base_path, "/+$", ""), "/")
    start = F.filter(F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))), lambda x: x != "")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.filter(F.split(path, "/"), lambda x: x != ""), start, step)
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("/"), x)), "")


def normalise(link: Column, base: Column, fragment_is_self: bool = False, strict: bool = False) -> Column:
    """The absolute form of ``link`` on the page ``base``, or null if it leads to no page (URL2, URL4); see :func:`absolute`."""
    if strict:
        return strict_absolute(link, base, fragment_is_self)
    return absolute(link, plain_parts(link), base, plain_parts(base), fragment_is_self)


def absolute(link: Column, own: Column, base: Column, root: Column, fragment_is_self: bool = False) -> Column:
    """:func:`normalise` from the :func:`plain_parts` ``own`` of the link and ``root`` of the base, so that they are computed once.

    Null for links of a fragment alone (or the base itself, if ``fragment_is_self``), for schemes other than http and https,
    for files of other kinds by their extension and for results that contain ``null``. What stands after the last ``#`` goes. A scheme is told by ``//``
    alone, so ``mailto:x`` is a relative path and ``//host/x`` a path on the base's host; a path that starts with a slash
    keeps its dots. A link without a host takes the base's scheme, host and port; other links get the port of their scheme.
    """
    path = F.regexp_replace(own["path"], "(?s)#[^#]*$", "")
    extension = F.lower(F.regexp_extract(path, "(?s)[.]([^.]*)$", 1))
    whole = F.when(path.startswith("/"), path).otherwise(joined_path(path, root["path"]))
    scheme = F.lower(own["scheme"])
    outside = F.concat(own["scheme"], F.lit("://"), own["host"], F.lit(":"), F.coalesce(own["port"], F.when(scheme == "https", "443").otherwise("80")), whole)
    inside = F.concat(root["scheme"], F.lit("://"), root["host"], F.lit(":"), root["port"], whole)
    out = F.when(own["scheme"].isNull(), inside).when(scheme.isin("http", "https"), outside)
    out = F.when(~extension.isin(BAD_EXTENSIONS) & ~out.contains("null"), out)
    return F.when(own["path"].startswith("#"), base if fragment_is_self else F.lit(None).cast("string")).otherwise(out)


def strict_absolute(link: Column, base: Column, fragment_is_self: bool = False) -> Column:
    """:func:`normalise` by the rules of URLs: dots are resolved everywhere, ``//host/x`` names a host, and other schemes are null."""
    bare = F.trim(F.regexp_replace(link, "#.*$", ""))
    b = parts(base)
    site = F.concat(b["scheme"], F.lit("://"), b["host"], F.lit(":"), F.coalesce(b["port"], default_port(b["scheme"])))
    directory = F.regexp_replace(F.regexp_replace(F.coalesce(b["path"], F.lit("/")), "[?].*$", ""), "[^/]*$", "")
    own = parts(bare)
    scheme = F.lower(own["scheme"])
    absolute = F.concat(scheme, F.lit("://"), F.lower(own["host"]), F.lit(":"), F.coalesce(own["port"], default_port(scheme)), resolve_path(F.coalesce(F.nullif(own["path"], F.lit("")), F.lit("/"))))
    out = (
        F.when(bare == "", base if fragment_is_self else F.lit(None).cast("string"))
        .when(bare.rlike("^(?i)https?://"), absolute)
        .when(bare.startswith("//"), F.concat(b["scheme"], F.lit(":"), F.lower(F.regexp_extract(bare, "^(//[^/:]*)", 1)), F.lit(":"), default_port(b["scheme"]), resolve_path(F.coalesce(F.nullif(F.regexp_replace(bare, "^//[^/]*", ""), F.lit("")), F.lit("/")))))
        .when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(bare.startswith("/"), F.concat(site, resolve_path(bare)))
        .otherwise(F.concat(site, resolve_path(F.concat(F.when(directory == "", "/").otherwise(directory), bare))))
    )
    extension = F.lower(F.regexp_extract(F.regexp_replace(out, "[?].*$", ""), "[.]([a-zA-Z0-9]+)$", 1))
    return F.when(~extension.isin(BAD_EXTENSIONS) & ~out.contains("null"), out)


def redirect(target: Column, base: Column) -> Column:
    """A redirect's target as a start URL, on the base's host where it names none (URL5)."""
    return F.when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), seed(target)).otherwise(normalise(target, base, strict=True))


def encode(text: Column) -> Column:
    """Form encoding of a text (URL6)."""
    return F.url_encode(text)


def decode(text: Column) -> Column:
    """The text of a form encoding (URL6)."""
    return F.url_decode(text)


def row_key(url: Column) -> Column:
    """The key of a URL's row: the SHA-1 of the reversed URL, so that keys of one host spread (HSH1)."""
    return F.sha1(F.reverse(url))
