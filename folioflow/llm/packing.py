"""Packing token sequences into windows: non-negative least squares over length combinations."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import SPACES, batch_words, byte_values
from ._work import materialise

_TABLE = byte_values(SPACES)
LOT = 64  # words of letters that are encoded in one call

LETTER, DIGIT, MARK = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = MARK
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[ord("|")] = 0  # stands inside <|endoftext|>


def piece_cuts(data: np.ndarray) -> np.ndarray:
    """Where the tokenizer surely begins a new piece inside a word, by the byte that begins it.

    Its pieces are runs of letters, single digits, runs of marks, and endings such as 's. ASCII
    and the letters of Latin-1 (two bytes, 0xC3 first) tell this by themselves; nothing is cut
    beside other characters, which may be of any kind or join the one before, between an
    apostrophe and a letter, or at a bar.
    """
    kind, out = _KIND[data], np.zeros(len(data), bool)
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
        kind[lead] = kind[lead + 1] = LETTER
        left, right = kind[:-1], kind[1:]
        out[1:] = (left != 0) & (right != 0) & ((left != right) | (right == DIGIT))
        out[1:] &= (data[:-1] != ord("'")) | (right == DIGIT)
    return out


class WordTokenizer:
    """Token ids of whole texts from those of their pieces.

    The tokenizer lower-cases and never joins anything over white space or ``piece_cuts``, so
    a text's ids are those of its pieces one after the other. Pieces are told apart by 64-bit
    hashes (A-Z as a-z, but in those that may hold a special token) and given to the tokenizer
    once; they are forgotten when there are more than ``most``.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.begin = np.zeros(0, np.int64)  # of each key's ids
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.end = 0

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words one after the other, the order in which they stand there, and how many each has.

        Words of letters go to the tokenizer in lots, and their ids are told apart by the
        tokens that close a word. Each word has one such token at least, so if there are as
        many as words, each has one; another lot's words go one by one, as do other words.
        """
        size = np.zeros(len(words), np.int64)
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        alone, order, flat = [np.flatnonzero(~letters)], [], []
        plain = np.flatnonzero(letters)
        lots = [plain[at : at + LOT] for at in range(0, len(plain), LOT)]
        encoded = self.tokenizer.encode_batch_fast([" ".join([words[k] for k in lot.tolist()]) for lot in lots], add_special_tokens=False)
        for lot, one in zip(lots, encoded, strict=True):
            ids = np.array(one.ids, np.uint32)
            last = np.flatnonzero(self.closing[ids]) + 1
            if len(last) == len(lot):
                size[lot] = np.diff(last, prepend=0)
                order.append(lot)
                flat.append(ids)
            else:
                alone.append(lot)
        rest = np.concatenate(alone)
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in rest.tolist()], add_special_tokens=False)]
        size[rest] = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat.append(np.fromiter(chain.from_iterable(encoded), np.uint32, int(size[rest].sum())))
        return np.concatenate(flat), np.concatenate([*order, rest]), size

    def learn(self, keys: np.ndarray, places: np.ndarray, words: list[str]) -> None:
        """Add words; ``keys`` are sorted, not yet known, and belong at ``places``."""
        flat, order, size = self.spell(words)
        end = self.end + len(flat)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[self.end : end] = flat
        begin = np.empty_like(size)
        begin[order] = self.end + np.cumsum(size[order]) - size[order]
        self.keys = np.insert(self.keys, places, keys)
        self.begin = np.insert(self.begin, places, begin)
        self.size = np.insert(self.size, places, size)
        self.end = end

    def encode(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text of a column with ``end_id`` behind them; null texts are empty."""
        for a, b, words in batch_words(column, _TABLE, 1 << 20, piece_cuts):
            if len(self.keys) > self.most:
                self.forget()
            ends = words.ends()
            special = np.flatnonzero((words.data[:-1] == ord("<")) & (words.data[1:] == ord("|")))
            for k in np.unique(np.searchsorted(words.starts, special, "right") - 1).tolist():  # their case counts
                words.hashes[k] = int.from_bytes(blake2b(words.data[words.starts[k] : ends[k]], digest_size=8).digest())
            distinct, sample, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            places = np.searchsorted(self.keys, distinct)
            known = places < len(self.keys)
            known[known] = self.keys[places[known]] == distinct[known]
            if not known.all():
                raw = words.data.tobytes()
                new = sample[~known]
                spell = [raw[x:y].decode() for x, y in zip(words.starts[new].tolist(), ends[new].tolist(), strict=True)]
                self.learn(distinct[~known], places[~known], spell)
                places = np.searchsorted(self.keys, distinct)
            places = places[inverse]
            sizes = self.size[places]
            flat = self.ids[_runs(self.begin[places], sizes)]
            cuts = np.concatenate([[0], np.cumsum(sizes)])[words.first]
            for k in range(b - a):
                yield np.append(flat[cuts[k] : cuts[k + 1]], np.uint32(end_id))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: its words serve all tasks that the worker runs."""
    return WordTokenizer(path)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes begin[k], begin[k] + 1, ... of each run, one run after the other."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


PIECES = "doc_id {}, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def cut(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every document; only its last one is shorter.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, null without ``keep_ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for batch in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for k, ids in enumerate(words.encode(batch.column("text"), end_id)):
                raw = memoryview(ids.astype("<u4").tobytes())
                for at in range(0, len(ids), window):
                    piece = raw[4 * at : 4 * (at + window)]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
                    kept.append(bytes(piece) if keep_ids else None)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(docs.schema["doc_id"].dataType.simpleString()))


def nnls(columns: np.ndarray, target: np.ndarray, most: int = 600) -> np.ndarray:
    """min |A x - target| for x >= 0, by Lawson and Hanson's active sets.

    ``columns``: for each unknown the three rows to which it adds 1 (-1: none).
    """
    rows, unknowns = len(target), len(columns)
    A = np.zeros((rows, unknowns), np.float32)
    for part in range(columns.shape[1]):
        some = columns[:, part] >= 0
        np.add.at(A, (columns[some, part], np.flatnonzero(some)), 1)
    x = np.zeros(unknowns)
    active: list[int] = []
    for _ in range(most):
        gain = A.T @ (target - A[:, active] @ x[active]).astype(np.float32)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-3 * max(1.0, float(target.max())):
            break
        active.append(best)
        while active:
            part = A[:, active].astype(float)
            s = np.linalg.lstsq(part, target, rcond=None)[0]
            if (s > 0).all():
                x[active] = s
                break
            now, bad = x[active], s <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - s[bad], 1e-12))
            x[active] = now + step * (s - now)
            gone = [a for a, value, out in zip(active, x[active], bad, strict=True) if value <= 1e-9 and out]
            x[gone] = 0
            active = [a for a in active if a not in gone]
            if not gone:
                break
    return x


def combinations(bins: int) -> np.ndarray:
    """All ways to fill ``bins`` with one, two or three parts, largest first; -1 fills up the row."""
    found = [(bins, -1, -1)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c <= b:
                found.append((a, b, c or -1))
    return np.array(found)


def plan(histogram: np.ndarray, window: int = 2048, quantum: int = 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for all pieces of a histogram of lengths (index: length), and the number of sequences.

    Full pieces are sequences of their own. Lengths are rounded up to ``quantum`` into bins;
    repeat counts of the combinations that fill a window exactly are solved by ``nnls`` and
    rounded down. What is left is packed greedily by exact length: the longest length, then
    the longest that fits, and so on, as often as the scarcest of them lasts.

    A slot (length, first, last, sequence, place) gives the pieces of that length numbered
    first to last (exclusive) their sequences, counted up from ``sequence``. Slots are
    bounded by the window, not by the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    slots: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def take(length: int, count: int, base: int, place: int) -> None:
        slots.append((length, int(used[length]), int(used[length]) + count, base, place))
        used[length] += count
        left[length] -= count

    if left[window]:
        count = int(left[window])
        take(window, count, 0, 0)
        sequence += count
    bins = window // quantum
    binned = np.zeros(bins + 1)
    np.add.at(binned, -(-np.arange(1, window + 1) // quantum), left[1:])
    combos = combinations(bins)[1:]
    repeats = np.floor(nnls(combos - (combos > 0), binned[1:]) + 1e-6).astype(np.int64)
    for combo, count in zip(combos[repeats > 0], repeats[repeats > 0], strict=True):
        parts = [b for b in combo.tolist() if b > 0]
        room = {b: int(left[(b - 1) * quantum + 1 : b * quantum + 1].sum()) // parts.count(b) for b in parts}
        count = min(int(count), *room.values())
        for place, b in enumerate(parts):
            base, need = sequence, count
            for length in range(b * quantum, (b - 1) * quantum, -1):
                some = min(need, int(left[length]))
                if some:
                    take(length, some, base, place)
                    base, need = base + some, need - some
        sequence += count
    while left.any():
        room, parts = window, {}
        lengths = np.flatnonzero(left)
        while room and len(lengths := lengths[lengths <= room]):
            length = int(lengths[-1])
            parts[length] = min(room // length, int(left[length]))
            room -= length * parts[length]
            lengths = lengths[:-1]
        count = min(int(left[n]) // times for n, times in parts.items())
        place = 0
        for length, times in parts.items():
            for _ in range(times):
                take(length, count, sequence, place)
                place += 1
        sequence += count
    return slots, sequence


def pack(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, keep_ids: bool = False, quantum: int = 8, salts: int = 256) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``window`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with
    ``keep_ids``. Null and empty texts are documents of the end id alone. Repeated rows are
    packed one by one; equal pieces tie and any order of them gives equal rows. An empty
    table gives no rows; other columns are ignored.

    Only the histogram of piece lengths (one row per length) comes to the driver. Pieces
    of a length are numbered over ``salts`` parts, so that a frequent length meets in no one
    task, and their slots are looked up in the plan, which is bounded by the window.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer, window=window, end_id=end_id, keep_ids=keep_ids), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    slots, _ = plan(histogram, window, quantum)
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    counts = salted.groupBy(F.col("length").alias("c_length"), F.col("salt").alias("c_salt")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("c_length").orderBy("c_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("c_length", "c_salt", before.alias("before"))
    ranked = salted.withColumn("nth", nth).join(counts, (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt")))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("nth")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, batch.column("length").to_numpy().astype(np.int64) << 40 | rank, "right") - 1
            where = table[slot] if len(table) else np.zeros((0, 5), np.int64)
            columns = [*batch.columns[:6], pa.array(where[:, 3] + rank - where[:, 1]), pa.array(where[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:6], "sequence_id", "place"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in ranked.dtypes[:6])
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, place long")
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), "ids")
    return out if keep_ids else out.drop("ids")
