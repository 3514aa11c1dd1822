"""Places in texts: copies to search with their coordinates, locators of sentences, quotes.

Offsets count code points from 0.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CONTEXT = 32
_GRAPHEME = regex.compile(r"\X")
_COPY = StructType([StructField("text", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))])
_FOUND = StructType([StructField("status", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())])


def copy_of(text: str) -> tuple[str, list[int], list[int]]:
    """The text in compatibility form and lower case with single spaces, and where each of its letters begins and ends in the text."""
    letters, starts, ends = [], [], []
    for found in _GRAPHEME.finditer(text):
        for letter in unicodedata.normalize("NFKC", found.group()):
            if letter.isspace() and letters and letters[-1] == " ":
                ends[-1] = found.end()
                continue
            letters.append(" " if letter.isspace() else letter)
            starts += [found.start()] * len(letters[-1].lower())
            ends += [found.end()] * len(letters[-1].lower())
    return "".join(letters).lower(), starts, ends


@F.pandas_udf(_COPY)
def search_copy(text: pd.Series) -> pd.DataFrame:
    """struct(text, starts, ends): a copy to be searched; null is empty."""
    return pd.DataFrame([copy_of(t or "") for t in text], columns=["text", "starts", "ends"])


def source_range(copy: Column, start: Column, stop: Column) -> Column:
    """struct(start, stop) in the text of a hit at [start, stop) of its copy; null beyond it."""
    inside = (start >= 0) & (stop > start) & (stop <= F.length(copy["text"]))
    return F.when(inside, F.struct(F.get(copy["starts"], start).alias("start"), F.get(copy["ends"], stop - 1).alias("stop")))


def locator(text: Column, start: Column, stop: Column, rev: Column) -> Column:
    """struct(rev, start, stop, exact, prefix, suffix): a place with 32 letters around it; ends beyond the text are moved in."""
    size = F.length(text)
    low = F.greatest(F.lit(0), F.least(size, start)).cast("int")
    high = F.greatest(low, F.least(size, stop)).cast("int")
    before = F.greatest(F.lit(0), low - CONTEXT)
    part = lambda a, n: F.substring(text, a + 1, n)
    return F.struct(rev.alias("rev"), low.alias("start"), high.alias("stop"), part(low, high - low).alias("exact"), part(before, low - before).alias("prefix"), part(high, F.lit(CONTEXT)).alias("suffix"))


def _shared(left, right) -> int:
    """How many of the first letters agree."""
    count = 0
    for a, b in zip(left, right):
        if a != b:
            break
        count += 1
    return count


def found_place(text: str, rev: str | None, place: dict) -> tuple[str, int | None, int | None]:
    exact, start = place["exact"], place["start"]
    if not exact or len(exact) > 10_000 or len(exact) != place["stop"] - start:
        return "unresolved", None, None
    if place["rev"] == rev and text[start : place["stop"]] == exact:
        return "exact", start, place["stop"]
    best, ties, at = None, 0, text.find(exact)
    while at >= 0:
        agree = _shared(reversed(place["prefix"]), reversed(text[max(0, at - CONTEXT) : at])) + _shared(place["suffix"], text[at + len(exact) : at + len(exact) + CONTEXT])
        rank = (-agree, abs(at - start))
        if best is None or rank < best[0]:
            best, ties = (rank, at), 1
        elif rank == best[0]:
            ties += 1
        at = text.find(exact, at + 1)
    return ("candidate", best[1], best[1] + len(exact)) if ties == 1 else ("unresolved", None, None)


@F.pandas_udf(_FOUND)
def resolved_locator(text: pd.Series, rev: pd.Series, place: pd.DataFrame) -> pd.DataFrame:
    """struct(status, start, stop) of a locator in a text: exact in the same revision, else the one best candidate.

    Candidates rank by the letters around them that agree, then by distance; two equal best ones,
    none, an empty place and a null text are unresolved.
    """
    rows = [found_place(t or "", r, p) for t, r, p in zip(text, rev, place.to_dict("records"))]
    return pd.DataFrame({"status": [r[0] for r in rows], "start": pd.array([r[1] for r in rows], "Int32"), "stop": pd.array([r[2] for r in rows], "Int32")})


def last_quote(place: Column, most: int = 120) -> Column:
    """The text from the beginning of the sentence that holds a locator's start, at most ``most`` letters; empty without a place.

    A sentence that began before the known context is shown from the place on.
    """
    ends = r"(?s)^.*(?:[.!?…。！？][\"'”’)\]]*\s+|\n)"
    prefix = F.coalesce(place["prefix"], F.lit(""))
    begun = F.when(F.regexp_like(prefix, F.lit(ends)), F.regexp_replace(prefix, ends, "")).otherwise("")
    quote = F.trim(F.regexp_replace(F.concat(begun, place["exact"], F.coalesce(place["suffix"], F.lit(""))), r"\s+", " "))
    return F.when(F.coalesce(F.trim(F.regexp_replace(place["exact"], r"\s+", " ")) != "", F.lit(False)), F.rtrim(F.left(quote, F.lit(most)))).otherwise("")
