"""Stable JSON and seeded numbers, as column expressions where SQL has the means."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def stable_json(value: pd.Series) -> pd.Series:
    """JSON without spaces and with sorted keys at every level; what is no JSON, or null, is null."""

    def stable(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return value.map(stable)


def json_line(**fields: Column) -> Column:
    """An object of the fields as JSON with sorted keys and a line end; null fields stay, letters are not escaped."""
    return F.concat(F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))), {"ignoreNullFields": "false"}), F.lit("\n"))


_WORD = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(a: Column, b: Column) -> Column:
    """The product of two unsigned 32-bit words modulo 2^32, without overflow of 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, F.shiftright(a, 16) * b
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def seed(text: Column) -> Column:
    """FNV-1a of a text's code points as an unsigned 32-bit word in a long; null is empty."""
    points = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    return F.aggregate(points, F.lit(0x811C9DC5).cast("long"), lambda h, c: _times(h.bitwiseXOR(c), F.lit(0x01000193).cast("long")))


def seeded_number(text: Column, draw: Column) -> Column:
    """The draw-th number (from 1) in [0, 1) of the generator that the text seeds (mulberry32); any draw without the ones before."""
    state = (seed(text) + _times(draw.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(F.lit(_WORD))

    def first(s):
        return _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))

    def second(v):
        return (v + _times(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_WORD)).bitwiseXOR(v)

    mixed = _let(_let(_let(state, first), second), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 14)))
    return mixed / F.lit(4294967296.0)
