"""Toxicity by a counterfactual-regularised linear classifier over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import NON_ALNUM, Words, batch_words, byte_values, struct_field
from ._work import materialise, temporary

BITS = 18
STEMS = (4, 5)  # bytes
#: Fixed list: groups of terms that name people and may stand for one another in a sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "foreigner", "refugee", "native"),
    ("immigrants", "foreigners", "refugees", "natives"),
    ("old", "young", "elderly", "teenage"),
)
_TABLE = byte_values(NON_ALNUM)


def _index(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature, for each word and for the beginnings of longer words (stems)."""
    docs = words.docs()
    where, what = [docs], [_index(words.hashes)]
    for length in STEMS:
        longer, hashes = words.prefixes(length, length)
        where.append(docs[longer])
        what.append(_index(hashes))
    return np.concatenate(where), np.concatenate(what)


def word_features(words: list[str]) -> list[np.ndarray]:
    """The features of each word: its own and those of its stems."""
    found = []
    for _, _, parts in batch_words(pa.array(words, pa.string()), _TABLE):
        found += distinct_features(parts)
    return found


def distinct_features(words: Words) -> list[np.ndarray]:
    """Distinct features of each text."""
    docs, features = _features(words)
    pairs = np.unique(docs.astype(np.int64) << BITS | features)
    return np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(1, len(words.first) - 1)))


@dataclass
class Classifier:
    """Log-odds are ``bias`` plus the weights of the distinct features of a text."""

    weights: np.ndarray
    bias: float

    def odds(self, column: pa.Array) -> np.ndarray:
        """Log-odds of every text of a column; null texts are empty."""
        out = np.full(len(column), self.bias)
        for a, b, words in batch_words(column, _TABLE):
            docs, features = _features(words)
            telling = np.flatnonzero(self.weights[features])
            pairs = np.unique(docs[telling].astype(np.int64) << BITS | features[telling])
            out[a:b] += np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], b - a)
        return out


@cache
def swaps() -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For the hash of each identity term its own features, and those of each term that may take its place."""
    found = {}
    for group in IDENTITY_GROUPS:
        features = word_features(list(group))
        hashes = np.concatenate([w.hashes for _, _, w in batch_words(pa.array(group, pa.string()), _TABLE)])
        for k, x in enumerate(hashes.tolist()):
            found[x] = [(features[k], other) for j, other in enumerate(features) if j != k]
    return found


def counterfactuals(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text its swaps: numbers of the swaps, features, and what a swap adds to each (1 or -1).

    A swap puts another term of its group in all places of an identity term. The text loses
    the term's features, word and stems, but for those that its other words still hold, and
    gains those of the other term that it doesn't yet hold.
    """
    table, none = swaps(), np.zeros(0, np.int32)
    out = [(none, none, none)] * (len(words.first) - 1)
    terms = np.flatnonzero(np.isin(words.hashes, np.fromiter(table, np.uint64, len(table))))
    if not len(terms):
        return out
    docs = words.docs()
    where, what = [np.arange(len(docs))], [_index(words.hashes)]
    for length in STEMS:
        longer, hashes = words.prefixes(length, length)
        where.append(longer)
        what.append(_index(hashes))
    where, what = np.concatenate(where), np.concatenate(what)
    order = np.argsort(docs[where], kind="stable")
    where, what = where[order], what[order]
    cuts = np.searchsorted(docs[where], np.arange(len(out) + 1))
    for doc in np.unique(docs[terms]).tolist():
        own_words, features = where[cuts[doc] : cuts[doc + 1]], what[cuts[doc] : cuts[doc + 1]]
        swap, feature, sign, n = [], [], [], 0
        for term in np.unique(words.hashes[terms[docs[terms] == doc]]).tolist():
            rest = np.unique(features[words.hashes[own_words] != np.uint64(term)])
            for before, after in table[term]:
                for changed, value in ((np.setdiff1d(np.setdiff1d(before, rest), after), -1), (np.setdiff1d(np.setdiff1d(after, rest), before), 1)):
                    swap.append(np.full(len(changed), n, np.int32))
                    feature.append(changed)
                    sign.append(np.full(len(changed), value, np.int32))
                n += 1
        out[doc] = tuple(np.concatenate(x).astype(np.int32) for x in (swap, feature, sign))
    return out


def train(rows: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = (), *, fairness: float = 4.0, least: int = 3, sparsity: float = 1e-4, steps: int = 160, rate: float = 0.15) -> Classifier:
    """Proximal Adam on logistic loss, an L1 penalty, and the squared score changes of counterfactuals.

    Weights are not negative: no amount of other words in a long text excuses an insult.
    ``rows`` are the distinct features of each text and ``pairs`` its ``counterfactuals``:
    the penalty is ``fairness`` times the mean over all swaps of the squared change of the
    log-odds. Features that fewer than ``least`` texts hold have no weight, so a swap can't
    be evened out by raising a term that the texts don't have. Without rows, or with one
    class only, the classifier knows nothing but the (smoothed) share of that class.
    """
    size = 1 << BITS
    weights = np.zeros(size)
    share = (toxic.sum() + 1.0) / (len(toxic) + 2.0) if len(toxic) else 0.1
    bias = float(np.log(share / (1 - share)))
    if len(rows) == 0 or len(set(toxic.tolist())) < 2:
        return Classifier(weights, bias)
    # Texts are read a thousand at a time, so that no list of all features is made again and again.
    parts = [rows[at : at + 1000] for at in range(0, len(rows), 1000)]
    counts = np.zeros(size, np.int64)
    for part in parts:
        counts += np.bincount(np.concatenate(part), minlength=size)
    held = counts >= max(1, least)  # what one or two texts hold teaches nothing
    seen = np.flatnonzero(held)
    place = np.full(size, -1, np.int32)
    place[seen] = np.arange(len(seen))
    flats = [place[x[held[x]]] for x in map(np.concatenate, parts)]
    sizes = [np.array([int(held[x].sum()) for x in part]) for part in parts]
    starts = np.cumsum([0, *(int(p[0].max()) + 1 if len(p[0]) else 0 for p in pairs)])
    swap = np.concatenate([p[0] + start for p, start in zip(pairs, starts, strict=False)] or [np.zeros(0, int)])
    feature, sign = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, int)]) for k in (1, 2))
    known = place[feature] >= 0
    swap, feature, sign = swap[known], place[feature[known]], sign[known].astype(float)
    count = max(1, int(starts[-1]))
    w, m, v = (np.zeros(len(seen)) for _ in range(3))
    for step in range(1, steps + 1):
        grad, total, at = np.zeros(len(seen)), 0.0, 0
        for flat, own in zip(flats, sizes, strict=True):
            doc = np.repeat(np.arange(len(own)), own)
            odds = bias + np.bincount(doc, w[flat], len(own))
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - toxic[at : at + len(own)]) / len(rows)
            grad += np.bincount(flat, error[doc], len(seen))
            total, at = total + float(error.sum()), at + len(own)
        change = np.bincount(swap, sign * w[feature], count)
        grad += 2 * fairness / count * np.bincount(feature, sign * change[swap], len(seen))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        now = rate * (1 - (step - 1) / steps)  # small last steps settle weights between loss and penalty
        scale = now / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= scale * m / (1 - 0.9**step)
        w = np.maximum(w - np.minimum(scale, 1e3) * sparsity, 0)
        bias -= rate * total
    weights[seen] = w
    return Classifier(weights, bias)


LABELLED = "spread long, doc_id long, toxic int, features binary, swap binary, swap_feature binary, swap_sign binary"


def labelled_features(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Distinct features, counterfactuals and label of at most ``max_docs`` labelled documents.

    They are those with the smallest hashes of their ids. A document with several labels
    counts as toxic if one says so; null labels and null ids don't count, repeated rows of a
    document each do. Ids that aren't whole numbers are an error.
    """
    chosen = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spread = F.xxhash64(F.lit("toxic-sample"), F.col("doc_id").cast("long")).alias("spread")
    chosen = chosen.orderBy(spread, "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(spread, F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")  # at most max_docs rows of two numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pairs = [], []
            for _, _, words in batch_words(batch.column("text"), _TABLE):
                found += [x.tobytes() for x in distinct_features(words)]
                pairs += counterfactuals(words)
            columns = [*(batch.column(c) for c in ("spread", "doc_id", "toxic")), pa.array(found, pa.binary()), *(pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in LABELLED.split(", ")])

    return rows.mapInArrow(features, LABELLED)


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 10_000, max_bytes: int = 64 << 20, **options) -> Classifier:
    """Train on a bounded sample: at most ``max_docs`` labelled documents, of at most ``max_bytes`` features in all.

    They are taken in the order of hashes of their ids; only their features come to the
    driver. Texts without words, null texts and an empty table are as in ``train``.
    """
    spark = docs.sparkSession
    with temporary(spark):
        rows = materialise(labelled_features(docs, labels, max_docs), "labelled")
        sizes = F.octet_length("features") + 3 * F.octet_length("swap") + 64
        so_far = F.sum(sizes.cast("long")).over(Window.orderBy("spread", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        cut = rows.select("spread", "doc_id", so_far.alias("so_far")).filter(F.col("so_far") <= max_bytes).agg(F.max(F.struct("spread", "doc_id")).alias("last")).first()["last"]  # a window over at most max_docs rows of numbers
        some = rows.filter(F.lit(False) if cut is None else (F.col("spread") < cut[0]) | ((F.col("spread") == cut[0]) & (F.col("doc_id") <= cut[1]))).collect()
    some.sort(key=lambda r: (r["spread"], r["doc_id"], bytes(r["features"]), r["toxic"]))
    read = lambda r, c: np.frombuffer(r[c], np.int32)
    pairs = [tuple(read(r, c) for c in ("swap", "swap_feature", "swap_sign")) for r in some]
    return train([read(r, "features") for r in some], np.array([min(1, max(0, r["toxic"])) for r in some], float), pairs, **options)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Row (the columns of ``docs``), score (0 to 1) and predicted of every document, from its whole text.

    Null and empty texts get the score of a text without words. Repeated rows are each
    scored; an empty table gives no rows. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.value.odds(struct_field(batch.column("row"), "text"))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["row", "score", "predicted"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.struct("*").alias("row")).mapInArrow(rate, T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, mod: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Learn from labels outside the held-out fold and score every document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words; repeated rows are each
    scored; very long texts are read whole. A null doc_id is not held out. Without labels
    every score is the smoothed share of no labels. An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % mod
    model = fit(docs, labels.filter(fold != held_out).select("doc_id", "toxic"), **options)
    found = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score", "predicted")
    return found.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_harmless(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted to be toxic, by a model of all labels.

    Columns stay as they are, whatever their names; null and empty texts stay unless a text
    without words is toxic by itself; repeated rows stay or go alike; an empty table gives
    no rows.
    """
    return score(docs, fit(docs, labels.select("doc_id", "toxic"), **options)).filter("predicted = 0").select("row.*")
