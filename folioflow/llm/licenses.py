"""License scans: ordered signature rules behind a keyword prefilter.

Rules are regular expressions over a text's words, lower-cased and joined by single
spaces. Each needs its keyword; only stretches of words around keywords are matched at
all. Detections that lie inside one of the same or higher priority are suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import NON_ALNUM, Words, byte_values, slices, utf8
from .license_signatures import TABLES

#: Fixed phrases whose places are counted, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

REACH = 64  # words; no detection is longer


@dataclass(frozen=True)
class Rule:
    """A signature. ``tier`` is the number of its table and ``order`` its place among all rules."""

    label: str
    keyword: str
    pattern: re.Pattern
    tier: int
    order: int
    sureness: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority."""
    lines = [(tier, sureness, *line) for tier, (table, sureness) in enumerate(TABLES) for line in table]
    return tuple(Rule(label, keyword, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"), tier, order, sureness) for order, (tier, sureness, label, keyword, pattern) in enumerate(lines))


@cache
def by_keyword() -> dict[str, tuple[Rule, ...]]:
    found: dict[str, list[Rule]] = {}
    for rule in rules():
        found.setdefault(rule.keyword, []).append(rule)
    return {k: tuple(v) for k, v in found.items()}


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # word
    last: int
    tier: int
    order: int
    sureness: float


def suppress(found: list[Detection]) -> list[Detection]:
    """Without those inside a detection of the same or an earlier table; of equal ones the earlier rule's stays.

    One sweep by first word, longest first, with the furthest end so far of each table: an
    earlier detection of the sweep holds the present one if it ends no sooner. Whatever
    holds a suppressed detection holds what that one holds, so suppressed ones count, too.
    """
    furthest = [-1] * len(TABLES)
    kept = []
    for x in sorted(found, key=lambda d: (d.first, -d.last, d.tier, d.order)):
        if max(furthest[: x.tier + 1]) < x.last:
            kept.append(x)
        furthest[x.tier] = max(furthest[x.tier], x.last)
    return kept


def detect(words: list[str], offset: int = 0) -> list[Detection]:
    """Detections of all rules of which the keyword is there; ``offset`` is the number of the first word."""
    tables = by_keyword()
    chosen = [rule for word in tables.keys() & set(words) for rule in tables[word]]
    if not chosen:
        return []
    text = " ".join(words)
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    found = []
    for rule in chosen:
        spans = np.array([m.span() for m in rule.pattern.finditer(text)]).reshape(-1, 2)
        places = np.searchsorted(begins, spans - [0, 1], "right") - 1 + offset
        found += [Detection(rule.label, first, last, rule.tier, rule.order, rule.sureness) for first, last in places.tolist()]
    return found


_TABLE = byte_values(NON_ALNUM)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array([" ".join(words)], pa.string()))
    return Words(data, offsets, _TABLE).hashes


def _lower(piece: np.ndarray) -> list[str]:
    """Words of bytes that begin and end at word borders, A-Z lower-cased."""
    upper = (piece >= 0x41) & (piece <= 0x5A)
    folded = np.where(upper, piece + 32, piece).astype(np.uint8)
    folded[_TABLE[piece] == 0] = 0x20
    return folded.tobytes().decode("utf-8", "replace").split(" ")


def scan_texts(column: pa.Array) -> Iterator[dict]:
    """One dict per text: n_words, base places, and detections that stay."""
    keywords = np.unique(_hashes(sorted(by_keyword())))
    phrases = [(_hashes(p.split()), label) for p, label in BASE_PHRASES]
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        words = Words(part, offsets[a : b + 1] - offsets[a], _TABLE)
        n = len(words.hashes)
        last_word = words.first[1:][words.docs()] if n else np.zeros(0, int)  # one past the last word of each word's text
        places: dict[int, list[tuple[int, str, int]]] = {}
        for phrase, label in phrases:
            at = np.flatnonzero(words.hashes == phrase[0])
            at = at[at + len(phrase) <= last_word[at]]
            for k in range(1, len(phrase)):
                at = at[words.hashes[at + k] == phrase[k]]
            for w in at.tolist():
                doc = int(np.searchsorted(words.first, w, "right")) - 1
                places.setdefault(doc, []).append((w - int(words.first[doc]), label, len(phrase)))
        near = np.flatnonzero(np.isin(words.hashes, keywords))
        detections: dict[int, list[Detection]] = {}
        for doc in np.unique(np.searchsorted(words.first, near, "right") - 1).tolist():
            lo, hi = int(words.first[doc]), int(words.first[doc + 1])
            own = near[(near >= lo) & (near < hi)]
            cuts = np.flatnonzero(np.diff(own) > 2 * REACH)
            found: list[Detection] = []
            for begin, stop in zip([own[0], *own[cuts + 1]], [*own[cuts], own[-1]], strict=True):
                first, last = max(lo, int(begin) - REACH), min(hi, int(stop) + REACH + 1) - 1
                end = words.starts[last + 1] if last + 1 < n else words.n
                stretch = [w for w in _lower(part[words.starts[first] : min(end, words.offsets[doc + 1])]) if w]
                found += detect(stretch, first - lo)
            detections[doc] = suppress(found)
        for doc in range(b - a):
            yield {"n_words": int(words.first[doc + 1] - words.first[doc]), "base": sorted(places.get(doc, [])), "found": detections.get(doc, [])}


RESULT = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,last_word:long,sureness:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """License mentions of every whole text.

    Null and empty texts have no words, no places (first_word and last_word null), empty
    label lists and score 0. Score is that of the surest mention; a base place is sure.
    Repeated rows are each scanned; an empty table gives no rows; other columns are ignored.
    """
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("sureness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for x in scan_texts(batch.column("text")):
                base, found = x["base"], x["found"]
                named = {label for _, label, _ in base}
                out["n_words"].append(x["n_words"])
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(named)))
                out["labels"].append(",".join(sorted(named | {d.label for d in found})))
                out["score"].append(1.0 if base else max((d.sureness for d in found), default=0.0))
                out["detections"].append([{"label": d.label, "first_word": d.first, "last_word": d.last, "sureness": d.sureness} for d in found])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, RESULT.format(kind))
