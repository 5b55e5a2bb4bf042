"""Column functions over the HTML of pages: elements, attributes, links, scripts and references of characters, by patterns.

They read well-formed pages of known layouts, as scraping rules do; none of them builds a tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import trimmed

# fixed values: the named references that text is usually escaped with
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}


def decoded(x: Column) -> Column:
    """Numeric and the usual named references as characters; the ampersand's last, so that nothing is decoded twice."""
    hexadecimal = lambda r: F.when(r.startswith("x") | r.startswith("X"), F.substring(r, 2, 8)).otherwise(F.hex(r.try_cast("long")))
    character = lambda r: F.decode(F.unhex(F.lpad(hexadecimal(r), 8, "0")), "UTF-32")
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    x = F.aggregate(found, x, lambda s, r: F.replace(s, F.concat(F.lit("&#"), r, F.lit(";")), F.coalesce(character(r), F.lit(""))))
    for name, plain in NAMED.items():
        x = F.replace(x, F.lit(name), F.lit(plain))
    return F.replace(x, F.lit("&amp;"), F.lit("&"))


def inner(html: Column, tag: str) -> Column:
    """What stands inside each element of that name which holds none of its own name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def text_of(html: Column) -> Column:
    """The text of a piece of HTML without tags, decoded, white space as one space, trimmed."""
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(html, r"(?s)<[^>]*>", "")), r"\s+", " "))


def attribute(html: Column, tag: str, name: str) -> Column:
    """The attribute of the first element of that name, decoded; null if there is none."""
    return decoded(F.nullif(F.regexp_extract(html, rf"""(?is)<{tag}\s(?:[^>]*\s)?{name}\s*=\s*["']([^"']*)["']""", 1), F.lit("")))


def links(html: Column, before: str = "") -> Column:
    """href and title of every link that has one, in order, as an array of structs; `before` is a pattern of what stands right before it."""
    pattern = rf"""(?is){before}<a\s(?:[^>]*\s)?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    part = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("href"), part(2).alias("title")), lambda x: F.struct(decoded(x["href"]).alias("href"), text_of(x["title"]).alias("title")))


def resolved(href: Column, url: Column) -> Column:
    """A link as it is meant on a page: whole, from the host (`/a`, `//host/a`), or from the page's folder."""
    root = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+", 0)
    folder = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*)?/)[^/?#]*(?:[?#].*)?$", 1)
    scheme = F.regexp_extract(url, r"^[a-zA-Z]+:", 0)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))


def script_with(html: Column, part: str) -> Column:
    """The first script that holds a piece of text; null if none does."""
    return F.get(F.filter(inner(html, "script"), lambda s: F.contains(s, F.lit(part))), F.lit(0))


def base_of(url: Column) -> Column:
    """A URL up to its query."""
    return F.regexp_extract(url, r"^[^?]*", 0)
