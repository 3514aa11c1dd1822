"""Text functions that stay in the JVM, but for Unicode's compatibility form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Between fields of a searchable row, so that a word never spans two of them.
FIELD_BREAK = "\x01"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form, which SQL lacks; null stays null. ASCII texts, which are in that form, stay in the JVM."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text)))


def squeezed(text: Column) -> Column:
    """Compatibility form in lower case without white space; null is empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"\s+", "")


def searchable(*fields: Column) -> Column:
    """All fields in one column to be searched; made once, when an index is written."""
    return F.regexp_replace(F.lower(nfkc(F.concat_ws(FIELD_BREAK, *(F.coalesce(f, F.lit("")) for f in fields)))), r"\s+", "")


def query_words(query: str) -> list[str]:
    """The words of a query in the form that ``searchable`` columns hold."""
    return unicodedata.normalize("NFKC", query).lower().split()


def contains_words(haystack: Column, query: str, every: bool = True) -> Column:
    """Whether all (or any) words of the query stand in a ``searchable`` column; an empty query matches."""
    found = [F.contains(haystack, F.lit(word)) for word in query_words(query)]
    if not found:
        return F.lit(True)
    out = found[0]
    for x in found[1:]:
        out = out & x if every else out | x
    return out


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; null texts are empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
