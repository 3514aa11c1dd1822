"""HTML: readable text by the standard parser, links and images by patterns in the JVM."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def plain_text(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Text()
    reader.feed(html)
    reader.close()
    return "\n".join(reader.parts)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text nodes outside scripts and styles, one a line; null stays null. Markup can be malformed, so a parser reads it."""
    return html.map(plain_text)


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def targets(html: Column, tag: str, attribute: str) -> Column:
    """The values of an attribute of all tags of a kind, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?i)<{tag}\s[^>]*?{attribute}="([^"]*)"'), F.lit(1))


def truncated(html: Column, tail: int = 64) -> Column:
    """Whether a body lacks the closing tag near its end."""
    return ~F.contains(F.lower(F.right(F.coalesce(html, F.lit("")), F.lit(tail))), F.lit("</html>"))


def resolved(base: Column, link: Column) -> Column:
    """An absolute URL for absolute, scheme-relative and rooted links; others stand beside the base's last slash."""
    origin, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(F.regexp_like(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(folder, link))
    )


class _Images(HTMLParser):
    """Attributes of the images of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.found.append({name: value or "" for name, value in reversed(attrs)})  # the first of repeated attributes counts


IMAGES = ArrayType(StructType([StructField("position", IntegerType())] + [StructField(n, StringType()) for n in ("source_url", "resolved_url", "host", "alt", "title", "width", "height")]))


def page_images(html: str | None, base: str | None) -> list[dict]:
    """The images of a page that have an http address; positions count all images, from 1."""
    reader, out = _Images(), []
    reader.feed(html or "")
    reader.close()
    for position, image in enumerate(reader.found, 1):
        source = image.get("src", "").strip()
        try:
            address = urljoin(base or "", source)
            parts = urlsplit(address)
            host = parts.hostname
        except ValueError:  # malformed addresses are no images
            continue
        if source and parts.scheme in ("http", "https") and host:
            out.append({"position": position, "source_url": source, "resolved_url": address, "host": host} | {a: image.get(a) for a in ("alt", "title", "width", "height")})
    return out


@F.pandas_udf(IMAGES)
def image_references(html: pd.Series, base: pd.Series) -> pd.Series:
    """The images of pages with their addresses made absolute; a page without (or null) has an empty list."""
    return pd.Series([page_images(h, b) for h, b in zip(html, base)], dtype=object)


def post_reference(url: Column) -> Column:
    """struct(board, post) of a post's address, ``/board/1`` or with ``bo_table`` and ``wr_id``; null for others."""
    path, query = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    short = r"^/([a-z0-9_]+)/([0-9]+)$"
    board = F.nullif(F.regexp_extract(query, r"(?:^|&)bo_table=([^&]+)", 1), F.lit(""))
    post = F.nullif(F.regexp_extract(query, r"(?:^|&)wr_id=([^&]+)", 1), F.lit(""))
    long = F.regexp_like(board, F.lit(r"^[a-z0-9_]+$")) & F.regexp_like(post, F.lit(r"^[0-9]+$"))
    reference = lambda b, p: F.struct(b.alias("board"), p.try_cast("long").alias("post"))
    return F.when(F.regexp_like(path, F.lit(short)), reference(F.regexp_extract(path, short, 1), F.regexp_extract(path, short, 2))).when(long, reference(board, post))


def first_text(*values: Column) -> Column:
    """The first of ordered candidates that is more than white space, trimmed."""
    return F.coalesce(*(F.nullif(F.regexp_replace(v, r"^\s+|\s+$", ""), F.lit("")) for v in values))


def category(*values: Column) -> Column:
    """The first candidate with text, without the square brackets around it; empty brackets are no category."""
    found = first_text(*values)
    return F.when(F.regexp_like(found, F.lit(r"(?s)^\[.*\]$")), F.nullif(F.trim(F.regexp_replace(found, r"(?s)^\[(.*)\]$", "$1")), F.lit(""))).otherwise(found)
