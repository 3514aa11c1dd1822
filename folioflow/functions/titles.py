"""Titles: normal form, base title, episode and status, series keys.

Titles are read from their end by small helpers that take one word, number or mark off at
a time; they run in Arrow UDFs, one pass per title.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which SQL lacks; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def key(text: Column) -> Column:
    """Folded text without anything but letters, digits and underscores."""
    return F.regexp_replace(folded(text), r"(?U)[^\w]+", "")


# The words that titles are made of. All are in folded form.
#: Tags that may stand before a title, in square brackets.
TITLE_TAGS = ("연재", "번역", "aa", "팬픽", "소설", "작품")
#: Marks of a title's state, in round or square brackets, and one that stands alone.
STATES = ("완", "완결", "수정", "재업")
BARE_STATE = "完"
#: What counts seasons, volumes and episodes behind a number; those of ``SHORT_UNITS`` may have a subtitle behind a colon.
SEASON_UNITS = ("기", "시즌", "season")
VOLUME_UNITS = ("권", "부", "volume", "vol.", "vol", "part")
SHORT_UNITS = ("화", "話", "회", "장", "편")
EPISODE_NAMES = ("chapter", "ch.", "ch", "episode", "ep.", "ep")
#: What may stand before a number.
ORDINAL = "제"
#: Words for special episodes with their class: before (0), between (1), beside (2) and behind (3) the others.
SPECIALS = {"프롤로그": 0, "서장": 0, "prologue": 0, "막간": 1, "interlude": 1, "외전": 2, "특별편": 2, "에필로그": 3, "epilogue": 3}
SIDE_STORIES = ("외전", "특별편")
#: Marks between a title and its episode.
BETWEEN = ":：/-–—·"
RANGES = "~～〜-"

DIGITS = "0123456789"


def _off(text: str, words: tuple[str, ...]) -> str | None:
    """``text`` without the longest of ``words`` at its end, or None."""
    ends = [w for w in words if text.endswith(w)]
    return text[: -len(max(ends, key=len))] if ends else None


def _number(text: str, *, fraction: bool = False) -> tuple[str, str] | None:
    """``text`` without the number at its end, and the number."""
    rest = text.rstrip(DIGITS)
    if rest == text:
        return None
    if fraction and rest.endswith(".") and rest[:-1].rstrip(DIGITS) != rest[:-1]:
        rest = rest[:-1].rstrip(DIGITS)
    return rest, text[len(rest) :]


def _ordinal(text: str) -> str:
    """``text`` without what may stand before a number."""
    before = _off(text.rstrip(), (ORDINAL,))
    return text if before is None else before


def _counted(text: str, units: tuple[str, ...]) -> tuple[str, str] | None:
    """``text`` without a whole number and one of ``units`` at its end, and the number."""
    before = _off(text.rstrip(), units)
    return None if before is None else _number(before.rstrip())


def _unit_episode(text: str) -> tuple | None:
    """(rest, season, volume, first, last) of a number or range with its unit at the end, and what counts above it."""
    before = _off(text, SHORT_UNITS + EPISODE_NAMES)
    last = None if before is None else _number(before.rstrip(), fraction=True)
    if last is None:
        return None
    rest, number = last
    first, end = number, None
    joined = rest.rstrip()
    if joined and joined[-1] in RANGES and (found := _number(joined[:-1].rstrip(), fraction=True)):
        rest, first, end = *found, number
    rest = _ordinal(rest)
    volume = season = None
    if found := _counted(rest, VOLUME_UNITS):
        rest, volume = _ordinal(found[0]), found[1]
    if found := _counted(rest, SEASON_UNITS):
        rest, season = found
    return rest, season, volume, first, end


def _marked_episode(text: str) -> tuple | None:
    """The same of #7, (7) and [7]."""
    for opening, closing in (("#", ""), ("(", ")"), ("[", "]")):
        if text.endswith(closing) and (found := _number(text[: len(text) - len(closing)].rstrip() if closing else text)):
            before = _off(found[0].rstrip(), (opening,))
            if before is not None:
                return before, None, None, found[1], None
    return None


def _named_episode(text: str) -> tuple | None:
    """The same of a name before the number, as in ep. 12."""
    found = _number(text, fraction=True)
    before = None if found is None else _off(found[0].rstrip(), EPISODE_NAMES)
    return None if before is None else (before, None, None, found[1], None)


def _subtitled_episode(text: str) -> tuple | None:
    """(rest, first, label, subtitle) of the first short unit with a colon and more behind it."""
    for colon in (k for k, c in enumerate(text) if c in ":："):
        before = _off(text[:colon].rstrip(), SHORT_UNITS)
        found = None if before is None else _number(before.rstrip(), fraction=True)
        if found and text[colon + 1 :].strip():
            rest = _ordinal(found[0])
            return rest, found[1], text[len(rest) : colon].strip(), text[colon + 1 :].lstrip()
    return None


def _without_tags(title: str) -> str:
    text = title.lstrip()
    while tag := next((t for t in TITLE_TAGS if text.startswith(f"[{t}]")), None):
        text = text[len(tag) + 2 :].lstrip()
    return " ".join(text.split())


def _state(text: str) -> tuple[str, str | None]:
    """``text`` without a mark of its state at the end, and that."""
    if text.endswith(BARE_STATE):
        return text[: -len(BARE_STATE)].rstrip(), BARE_STATE
    for word in STATES:
        before = _off(text, (f"({word})", f"[{word}]"))
        if before is not None:
            return before.rstrip(), word
    return text, None


def _trimmed(text: str) -> str:
    """Without marks and spaces at the end."""
    return text.rstrip(BETWEEN + " ")


def _ends_with_word(text: str, words: tuple[str, ...]) -> str | None:
    """``text`` without one of the words at its end, if it stands alone there."""
    before = _off(text.rstrip(), words)
    return before if before is not None and (not before or before[-1].isspace()) else None


def _whole(number: str | None) -> int:
    return int(number) if number is not None and len(number.lstrip("0")) < 10 else 0


def read_title(title: str | None) -> tuple:
    """(base, label, season, volume, class, start, end, status, subtitle, reason) of a folded title."""
    if title is None:
        return (None,) * 9 + ("no_episode",)
    text, status = _state(_without_tags(title))
    found, subtitle = _unit_episode(text) or _marked_episode(text) or _named_episode(text), None
    if found:
        rest, season, volume, first, last = found
        label = text[len(rest) :].strip()
    elif parts := _subtitled_episode(text):
        (rest, first, label, subtitle), season, volume, last = parts, None, None, None
    else:
        word = next((w for w in sorted(SPECIALS, key=len, reverse=True) if text.endswith(w)), None)
        if word:
            return _trimmed(text[: -len(word)]).strip(), word, 0, 0, SPECIALS[word], "0", "0", status, None, None
        opened = _number(text[:-1].rstrip()) if text[-1:] in (")", "]") else None
        numbered = opened and opened[0].rstrip()[-1:] in ("(", "[")
        return (text,) + (None,) * 6 + (status, None, "mismatched_bracket" if numbered else "no_episode")
    if last is not None and Decimal(last) < Decimal(first):
        return (text,) + (None,) * 6 + (status, subtitle, "reversed_range")
    base = _trimmed(rest)
    side = _ends_with_word(base, SIDE_STORIES)
    kind = 1 if side is None else 2
    return (base if side is None else side).strip(), label, _whole(season), _whole(volume), kind, first, last or first, status, subtitle, None


_NAMES = ("base", "label", "season", "volume", "class", "start", "end", "status", "subtitle", "reason")


def _struct(names: tuple[str, ...], numbers: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField(n, IntegerType() if n in numbers else StringType()) for n in names])


@F.pandas_udf(_struct(_NAMES, ("season", "volume", "class")))
def _read_titles(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_title(t) for t in titles], columns=_NAMES, dtype=object)


def parse(title: Column) -> Column:
    """struct(base, label, season, volume, class, start, end, status, subtitle, reason) of a folded title.

    class is 0 for prologues, 1 for episodes and interludes, 2 for side stories and 3 for
    epilogues; (season, volume, class, start, end) is the order of a work's episodes. reason
    is reversed_range or mismatched_bracket for titles that look numbered but aren't, and
    no_episode where nothing tells the place. An episode is, in order of priority, a number
    or range with its unit, a number behind # or in brackets, a number behind its unit's
    name, and a number with its unit before a colon and a subtitle. Numbers that don't fit
    decimal(20,6) or int count as 0.
    """
    exact = lambda c: F.when(c.isNotNull(), F.coalesce(c.try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")))
    return _let(_read_titles(title), lambda t: F.struct(*(exact(t[n]).alias(n) if n in ("start", "end") else t[n].alias(n) for n in _NAMES)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it stands in the result."""
    return F.transform(F.array(value), use)[0]


def display_title(title: Column, label: Column) -> Column:
    """The title in its own spelling without the episode label at its end; the label is found in any case."""
    ends = label.isNotNull() & F.endswith(F.lower(F.rtrim(title)), F.lower(label))
    bare = F.substring(F.rtrim(title), F.lit(1), F.length(F.rtrim(title)) - F.length(label))
    return F.when(ends, F.trim(F.regexp_replace(bare, rf"[\s{BETWEEN.replace('-', chr(92) + '-')}]+$", ""))).otherwise(F.trim(title))


# Fixed values of threads' titles: brackets of tags before them, and what may stand around the number behind them.
SERIES_TAGS = {"[": "]】", "【": "]】"}
SERIES_UNITS = ("어장", "편", "기", "화", "부", "차")
LOOSE = " -–—:~"
OPENING, CLOSING = "([【<〈《", ")]】>〉》"


def _loose(text: str, more: str = "") -> str:
    """Without spaces of any kind and loose marks at the end."""
    while text and (text[-1].isspace() or text[-1] in LOOSE + more):
        text = text[:-1]
    return text


def _without_number(text: str) -> str:
    """``text`` without a number at its end and what stands around it; as it is without one."""
    rest = _loose(text, ".")
    rest = _loose(rest[:-1] if rest and rest[-1] in CLOSING else rest)
    counted = _off(rest, SERIES_UNITS)
    found = _number((rest if counted is None else counted).rstrip())
    if found is None:
        return text
    rest = _loose(found[0])
    return _loose(rest[:-1] if rest and rest[-1] in OPENING else rest, ".")


def series_parts(title: str | None) -> tuple[str, str]:
    """(stem, tags) of a thread's title."""
    whole = unicodedata.normalize("NFKC", title or "").strip()
    rest = whole
    while rest.lstrip()[:1] in SERIES_TAGS and rest.lstrip():
        text = rest.lstrip()
        ends = [k for c in SERIES_TAGS[text[0]] if (k := text.find(c, 1)) > 0]
        if not ends:
            break
        rest = text[min(ends) + 1 :]
    tags = whole[: len(whole) - len(rest)].strip()
    rest = rest.lstrip() if tags else rest
    stem = " ".join(_without_number(rest).split()) or " ".join(rest.split()) or whole
    return stem, tags


@F.pandas_udf(_struct(("stem", "tags", "folded")))
def _series(titles: pd.Series) -> pd.DataFrame:
    found = [series_parts(t) for t in titles]
    return pd.DataFrame([(stem, tags, unicodedata.normalize("NFKC", stem).casefold()) for stem, tags in found], columns=["stem", "tags", "folded"], dtype=object)


def series(title: Column, username: Column) -> Column:
    """struct(key, stem, tags) of a thread's title: its stem has neither tags before it nor a number behind it.

    The key is the first 16 hex digits of SHA-256 over the author's trip (what follows ◆, else
    the whole name) and the folded stem. A title of nothing else keeps its number, then its tags.
    """
    parts = F.split(F.coalesce(username, F.lit("")), "◆", 2)
    trip = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))), r"(?U)^\s+|\s+$", "")
    return _let(_series(title), lambda s: F.struct(F.substring(F.sha2(F.concat(trip, F.lit("\n"), s["folded"]), 256), 1, 16).alias("key"), s["stem"].alias("stem"), s["tags"].alias("tags")))


#: Signs of an episode in a label, and the letter that makes them count rounds instead.
EPISODE_SIGNS = ("화", "話", "회")
ROUND_SIGN = "차"


@F.pandas_udf(LongType())
def _episode_numbers(labels: pd.Series) -> pd.Series:
    sign = re.compile(rf"([0-9]+)\s*(?:{'|'.join(EPISODE_SIGNS)})(?!{ROUND_SIGN})")

    def last(label: str | None) -> int | None:
        found = sign.findall(unicodedata.normalize("NFKC", label or ""))
        return int(found[-1]) if found and len(found[-1].lstrip("0")) < 19 else None

    return pd.Series([last(t) for t in labels], dtype="Int64")


def episode_number(label: Column) -> Column:
    """The last number of a label with an episode sign behind it, null without one; signs that count rounds don't."""
    return _episode_numbers(label)


def episode_gap(number: Column, following: Column) -> Column:
    """Episodes that lie between two numbers; none if numbering begins anew or a number is missing."""
    return F.coalesce(F.greatest(F.lit(0), following - number - 1), F.lit(0)).cast("long")


def reading_minutes(text: Column, per_minute: int = 500) -> Column:
    """Minutes to read a text at ``per_minute`` characters that are not spaces; at least 1."""
    return F.greatest(F.lit(1), F.round(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) / per_minute).cast("long"))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a text."""
    point = lambda c: F.ascii(c).cast("long")
    beyond = lambda c: F.array(F.lit(0xD800) + F.floor((point(c) - 0x10000) / 1024), F.lit(0xDC00) + F.pmod(point(c), F.lit(1024)))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    units = F.flatten(F.transform(letters, lambda c: F.when(point(c) >= 0x10000, beyond(c)).otherwise(F.array(point(c)))))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))


def hue(title: Column, hues: int = 10) -> Column:
    """The colour number of a title's cover."""
    return F.pmod(fnv1a(title), F.lit(hues)).cast("int")
