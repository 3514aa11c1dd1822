"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

Works on whole texts in slices of a quarter of a megabyte; the helpers know nothing of
Spark and are called from ``mapInArrow`` functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_M = 0x9E3779B97F4A7C15 | 1  # multiplier of the polynomial word hash; odd, so it has an inverse
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything but ASCII letters, digits and non-ASCII bytes.
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads nearby values (splitmix64)."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 18)
        base = np.full(size, _M, np.uint64)
        base[0] = 1
        _POW = np.multiply.accumulate(base)
        base[1:] = pow(_M, -1, 1 << 64)
        _INV = np.multiply.accumulate(base)
    return _POW, _INV


def byte_values(separators: bytes, seed: int = 1) -> np.ndarray:
    """256 random values: A-Z count as a-z, and separators as 0."""
    table = mix64(np.arange(1, 257, dtype=np.uint64), seed) | np.uint64(1)
    table[0x41:0x5B] = table[0x61:0x7B]
    table[list(separators)] = 0
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if buffers[1] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def struct_field(column: pa.Array, name: str) -> pa.Array:
    return column.field(column.type.get_field_index(name))


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a slice of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


class Words:
    """Words of a slice: ``starts`` and ``ends`` in bytes, ``first`` word of each text, and hashes.

    ``cuts`` tells from the bytes where words are cut further.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray] | None = None):
        n = len(data)
        values = table[data]
        inside = values != 0
        after = np.empty(n, bool)
        if n:
            after[0] = False
            after[1:] = inside[:-1]
            begins = offsets[:-1]
            after[begins[begins < n]] = False
        self.begins = inside & ~after
        if cuts is not None:
            self.begins |= inside & cuts(data)
        self.starts = np.flatnonzero(self.begins)
        self.first = np.searchsorted(self.starts, offsets)
        self.inside = inside
        self.data = data
        self.n = n
        self.offsets = offsets
        if len(self.starts):
            power, inverse = _powers(n)
            values *= power[:n]
            self.hashes = mix64(np.add.reduceat(values, self.starts) * inverse[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ends(self) -> np.ndarray:
        """One past the last byte of each word."""
        last = self.inside.copy()
        last[:-1] &= ~self.inside[1:] | self.begins[1:]
        return np.flatnonzero(last) + 1

    def prefixes(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than ``length`` bytes, and a hash of the first ``length`` bytes of each (A-Z as a-z)."""
        far = np.minimum(self.starts + length, self.n - 1)
        words = np.flatnonzero(self.inside[far] & (self.starts + length < self.n) & (np.append(self.starts[1:], self.n) > self.starts + length))
        table = byte_values(b"", seed)
        hashes = np.full(len(words), seed, np.uint64)
        for k in range(length):
            hashes = hashes * np.uint64(_M) + table[self.data[self.starts[words] + k]]
        return words, mix64(hashes)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def batch_words(column: pa.Array, table: np.ndarray, limit: int = 1 << 18, cuts: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets, limit):
        lo, hi = offsets[a], offsets[b]
        yield a, b, Words(data[lo:hi], offsets[a : b + 1] - lo, table, cuts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
