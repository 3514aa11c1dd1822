"""Token ids in binary files: ranks by frequency, byte-aligned numbers, control bytes apart.

A file holds the documents of one range of doc_id, in ascending order:

- blocks of 65,536 ids (the last one: fewer): two little-endian unsigned 32-bit numbers,
  the count of ids and of data bytes; control bytes, two bits an id with its length less
  one, four ids a byte from the lowest bits up; then the data bytes, each id's rank in as
  many little-endian bytes as its length says. The last control byte is filled up with
  ranks of 0, which have a data byte each.
- an Arrow stream of the documents' doc_id and n_tokens;
- the place and length of that stream (unsigned 64-bit numbers) and eight bytes ``MAGIC``.

``ranks.u32`` beside the files has the ids by rank, the most frequent first, as
little-endian unsigned 32-bit numbers: the 256 most frequent ids take one byte, the next
65,280 take two.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import _powers, mix64, slices, utf8
from ._work import materialise, own_dir, shuffle_partitions
from .packing import WordTokenizer, _runs

MAGIC = b"ids-v1\r\n"
BLOCK = 1 << 16
RANKS = "ranks.u32"

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64), 5) | np.uint64(1)
_CODE = np.arange(256)
_SPACE = np.isin(_CODE, [0x20, *range(0x09, 0x0E)])
_INK = (_CODE > 0x20) & (_CODE < 0x7F)  # surely no white space
_WORD = np.isin(_CODE, [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
_MARK = _INK & ~_WORD & (_CODE != 0x7C)  # without |, which encloses the names of special tokens
_JOINT = _CODE == 0x27  # begins a word's ending, as in it's
#: First bytes of characters that are no white space; those of the others may be.
_NEXT = _INK | (_CODE >= 0xC3) & ~np.isin(_CODE, [0xE1, 0xE2, 0xE3])


class ByteTokenizer(WordTokenizer):
    """Token ids of whole texts from those of their chunks.

    A byte-level tokenizer first cuts a text into words of letters, of digits or of marks,
    with at most one space before them, and into white space, of which the last character
    before a word stands alone. The ids of a text are those of its chunks if they end
    where such cuts surely are: before white space behind a word, before a space that a
    word follows, behind a single other white space, between letters or digits and marks
    (but behind an apostrophe). Chunks are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        super().__init__(path, most)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            name = np.frombuffer(token.content.encode(), np.uint8)
            if len(self.chunks(name, np.array([0, len(name)]))) > 1:
                raise ValueError(f"chunks would cut the special token {token.content}")

    def encode(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        data, offsets = utf8(column)
        for a, b in slices(offsets, 1 << 20):
            if len(self.keys) > self.most:
                self.forget()
            piece, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = self.chunks(piece, bounds)
            power, unpower = _powers(len(piece))
            hashes = mix64(np.add.reduceat(_BYTES[piece] * power[: len(piece)], starts) * unpower[starts]) if len(starts) else np.zeros(0, np.uint64)
            distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            places = np.searchsorted(self.keys, distinct)
            known = places < len(self.keys)
            known[known] = self.keys[places[known]] == distinct[known]
            if not known.all():
                ends, raw = np.append(starts[1:], len(piece)), piece.tobytes()
                new = sample[~known]
                spell = [raw[x:y].decode() for x, y in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                self.learn(distinct[~known], places[~known], spell)
                places = np.searchsorted(self.keys, distinct)
            places = places[inverse]
            sizes = self.size[places]
            flat = self.ids[_runs(self.begin[places], sizes)]
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]
            for k in range(b - a):
                yield np.append(flat[cuts[k] : cuts[k + 1]], np.uint32(end_id))

    @staticmethod
    def chunks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where chunks begin; every text that isn't empty begins one."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            before, here = data[:-1], data[1:]
            cut[1:-1] = _SPACE[here] & _INK[before] | _WORD[before] & _MARK[here] | (_MARK & ~_JOINT)[before] & _WORD[here]
            spaced = (before == 0x20) & _NEXT[here]
            spaced[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False  # the next byte is another text's
            cut[:-2] |= spaced
            cut[2:-1] |= _INK[data[:-2]] & (_SPACE & (_CODE != 0x20))[data[1:-1]] & _NEXT[data[2:]]
        cut[bounds] = True
        return np.flatnonzero(cut[:-1])


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One per Python worker: its chunks serve all tasks that the worker runs."""
    return ByteTokenizer(path)


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes of a plain id: two if all ids of the tokenizer fit, else four."""
    most = max(*byte_tokenizer(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values(), end_id)
    return 2 if most < 1 << 16 else 4


def tokenise(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned numbers of ``id_bytes``, ``end_id`` last) of every document."""
    plain = f"<u{id_bytes(tokenizer, end_id)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_tokenizer(tokenizer)
        for batch in batches:
            counts, kept = [], []
            for ids in words.encode(batch.column("text"), end_id):
                counts.append(len(ids))
                kept.append(ids.astype(plain).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) of every id that occurs: summed within each task, then over tasks; at most a row per id of the tokenizer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                own = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                small, sums = sorted((own, sums), key=len)
                sums[: len(small)] += small
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_block(ranks: np.ndarray) -> bytes:
    """A block of at most ``BLOCK`` ranks."""
    values = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    values[: len(ranks)] = ranks
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return struct.pack("<II", len(ranks), len(data)) + control.tobytes() + data.tobytes()


# For each control byte: its four lengths, where its four numbers begin, and what of four bytes each of them is.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_TOTAL = _SIZES.sum(axis=1)
_BEGIN = np.cumsum(_SIZES, axis=1) - _SIZES
_MASK = (np.uint64(1) << (8 * _SIZES).astype(np.uint64)).astype(np.uint64) - np.uint64(1)
_MASK = _MASK.astype(np.uint32)


def decode_block(count: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of a block, by one look at the tables for each control byte."""
    begin = np.cumsum(_TOTAL[control]) - _TOTAL[control]
    at = (begin[:, None] + _BEGIN[control]).ravel()[:count]
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    found = padded[at] | padded[at + 1] << np.uint32(8) | padded[at + 2] << np.uint32(16) | padded[at + 3] << np.uint32(24)
    return found & _MASK[control].ravel()[:count]


class _Writer:
    """One file: ids are handed on in full blocks, documents are listed at its end."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.out = store.open_output_stream(path, compression=None)
        self.place, self.ids, self.waiting, self.held = 0, 0, [], 0

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def add(self, ranks: np.ndarray) -> None:
        self.waiting.append(ranks)
        self.held += len(ranks)
        self.ids += len(ranks)
        if self.held >= BLOCK:
            held = np.concatenate(self.waiting)
            whole = len(held) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self.put(encode_block(held[at : at + BLOCK]))
            self.waiting, self.held = [held[whole:]], len(held) - whole

    def finish(self, listed: list[pa.RecordBatch]) -> None:
        if self.held:
            self.put(encode_block(np.concatenate(self.waiting)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, listed[0].schema) as stream:
            for batch in listed:
                stream.write_batch(batch)
        table = sink.getvalue()
        self.out.write(table)
        self.out.write(struct.pack("<QQ", self.place, len(table)) + MAGIC)
        self.out.close()


FILES = "file string, first_n long, first_row long, n_docs long, n_tokens long"


def write_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, file_ids: int = 64 << 20) -> DataFrame:
    """Write the ids of all documents to files in ``folder``; returns the list of files, already stored.

    ``folder`` is a URI that all machines share, of a kind that Arrow knows (file, hdfs, s3,
    gs, abfs). Texts are tokenised once; the driver gets the frequencies of the ids, at most
    a row for each of the tokenizer's. Documents are sorted by ranges of doc_id (nulls first;
    equal ones by number of ids, then as read, so that many rows of one doc_id may be spread
    over ranges). A task writes files of names that no other attempt uses, and only files of
    finished tasks are listed: what a lost executor leaves is in no list. Files are closed
    at the first document's end after ``file_ids`` ids. Columns of the list: file, doc_id,
    first_n, first_row (of the file's first document), n_docs, n_tokens and start, the ids
    in all files before. Null texts are empty; an empty table gives an empty list.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialise(tokenise(docs, tokenizer, end_id=end_id).withColumn("row", F.monotonically_increasing_id()), "tokens", codec="zstd")
    width = id_bytes(tokenizer, end_id)
    counted = sorted((-r["n"], r["id"]) for r in frequencies(tokens, width).collect())
    by_rank = np.array([i for _, i in counted], "<u4")
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{RANKS}", compression=None) as out:
        out.write(by_rank.tobytes())

    parts = max(shuffle_partitions(spark), -sum(n for n, _ in counted) // file_ids)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("row")]
    ordered = tokens.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        ranks, out, listed, name = shared.value, None, [], ""

        def close() -> pa.RecordBatch:
            out.finish([b.select(["doc_id", "n_tokens"]) for b in listed])
            first = listed[0].slice(0, 1)
            columns = [pa.array([name]), first.column("doc_id"), first.column("n_tokens"), first.column("row"), pa.array([sum(map(len, listed))]), pa.array([out.ids])]
            return pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "first_n", "first_row", "n_docs", "n_tokens"])

        try:
            for batch in batches:
                counts = batch.column("n_tokens").to_numpy()
                a = 0
                while a < len(batch):
                    if out is None:
                        name = f"ids-{uuid.uuid4().hex}"
                        out, listed = _Writer(store, f"{root}/{name}"), []
                    room = file_ids - out.ids
                    b = min(len(batch), a + 1 + int(np.searchsorted(np.cumsum(counts[a:]), room)))
                    for ids in batch.column("ids").slice(a, b - a):
                        out.add(ranks[np.frombuffer(ids.as_buffer(), f"<u{width}")])
                    listed.append(batch.select(["doc_id", "n_tokens", "row"]).slice(a, b - a))
                    a = b
                    if out.ids >= file_ids:
                        yield close()
                        out = None
            if out is not None:
                yield close()
                out = None
        finally:
            if out is not None:
                out.out.close()

    files = materialise(ordered.select("doc_id", "n_tokens", "row", "ids").mapInArrow(write, FILES.replace("first_n", f"doc_id {kind}, first_n")), "id-files")
    # A row per file: their order and sums fit in one task.
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "first_n", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))


def _file_ids(source: pa.NativeFile, end: int, by_rank: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a file, block by block."""
    place = 0
    while place < end:
        count, size = struct.unpack("<II", source.read_at(8, place))
        controls = -(-count // 4)
        raw = np.frombuffer(source.read_at(controls + size, place + 8), np.uint8)
        yield by_rank[decode_block(count, raw[:controls], raw[controls:])]
        place += 8 + controls + size


def read_documents(files: DataFrame, folder: str, *, keep_ids: bool = False) -> DataFrame:
    """Every document of the listed files: doc_id, start, n_tokens, ids_crc32 and, with ``keep_ids``, ids.

    ``files`` are rows of ``write_files``' list, all or some. Files are dealt out to tasks
    and read block by block; ``ids`` is an array of long. A file that is cut short or
    isn't of this format is an error; an empty list gives no rows.
    """
    kind = files.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{RANKS}") as source:
            by_rank = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    size = source.size()
                    tail = source.read_at(24, size - 24) if size >= 24 else b""
                    if tail[16:] != MAGIC:
                        raise ValueError(f"{file} is no file of ids")
                    place, length = struct.unpack("<QQ", tail[:16])
                    blocks = _file_ids(source, place, by_rank)
                    ready = np.zeros(0, "<u4")
                    for listed in pa.ipc.open_stream(source.read_at(length, place)):
                        crcs, kept = [], []
                        counts = listed.column("n_tokens").to_numpy()
                        for count in counts:
                            parts, missing = [], count
                            while missing > len(ready):
                                parts.append(ready)
                                missing -= len(ready)
                                ready = next(blocks)
                            parts.append(ready[:missing])
                            ready = ready[missing:]
                            crc = 0
                            for part in parts:
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                            if keep_ids:
                                kept.append(np.concatenate(parts).astype(np.int64))
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        columns = [listed.column("doc_id"), pa.array(starts), listed.column("n_tokens"), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if keep_ids:
                            columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(columns, names)

    out = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return files.select("file", "doc_id", "start").repartition(shuffle_partitions(files.sparkSession)).mapInArrow(read, out)


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Write the ids of all ``docs`` to files in the shared folder and read every document back.

    One row per input row. Null and empty texts are the end id alone; null doc_ids come
    first; repeated rows are documents of their own, one after the other; very long texts
    are kept whole; other columns are ignored; an empty table gives no rows. The files stay
    until the ``_work.temporary`` block ends.
    """
    folder = own_dir(docs.sparkSession, "ids")
    return read_documents(write_files(docs, tokenizer, folder, end_id=end_id), folder, keep_ids=keep_ids)
