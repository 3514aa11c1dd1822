"""Captured bodies in parts of WARC records: a data source whose parts count only once their write has been committed.

``df.write.format("captures")`` takes url, raw_sha256, status and body. Each task writes
parts of its own, a record a gzip member, and closes a part that has reached
``part_bytes``. The driver's commit is one file that lists the parts of all tasks; what a
failed or lost task has written is in no list, and a failed write removes its parts.
``spark.read.format("captures")`` reads the listed parts, each in a task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PART_BYTES = 1 << 30
SCHEMA = "url string, raw_sha256 string, status int, body binary"
_CHUNK = 4 << 20


def record_id(url: str, raw_sha256: str) -> str:
    """The record of a body under its address: the same wherever it is written, so a repeat can name it without a look."""
    return f"urn:uuid:{uuid.UUID(hashlib.sha256(f'{url}\n{raw_sha256}'.encode()).hexdigest()[:32])}"


def record(url: str, raw_sha256: str, status: int, body: bytes) -> bytes:
    """A response record as a gzip member."""
    phrase = next((s.phrase for s in HTTPStatus if s == status), "")
    http = f"HTTP/1.1 {status} {phrase}".rstrip().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <{record_id(url, raw_sha256)}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{raw_sha256}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[str, str, int, bytes]:
    """url, raw_sha256, status and body of a record; a body that isn't of its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    sha = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if hashlib.sha256(body).hexdigest() != sha:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields["WARC-Target-URI"], sha, int(http.split(b" ", 2)[1]), body


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: (name, records, bytes) of each part."""

    parts: list[tuple[str, int, int]]


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes, self.run = path, part_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/parts", recursive=True)
        parts: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, records, size = f"part-{self.run}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/parts/{name}", compression=None)
                    member = record(row["url"], row["raw_sha256"], row["status"], row["body"])
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= self.part_bytes:
                        out.close()
                        out = None
                        parts.append((name, records, size))
            if out is not None:
                out.close()
                out = None
                parts.append((name, records, size))
        finally:
            if out is not None:
                out.close()
        return Parts(parts)

    def commit(self, messages: list[Parts | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        listed = [p for m in messages if m is not None for p in m.parts]
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/commits/{name}.next", compression=None) as out:
            out.write(json.dumps({"parts": listed}).encode())
        store.move(f"{root}/commits/{name}.next", f"{root}/commits/{name}.json")

    def abort(self, messages: list[Parts | None]) -> None:
        _remove(self.path, f"part-{self.run}-")


def _remove(path: str, prefix: str, keep: frozenset[str] = frozenset()) -> int:
    store, root = pafs.FileSystem.from_uri(path)
    found = [f.path for f in store.get_file_info(pafs.FileSelector(f"{root}/parts", allow_not_found=True)) if f.base_name.startswith(prefix) and f.base_name not in keep]
    for name in found:
        store.delete_file(name)
    return len(found)


def sweep(path: str) -> int:
    """Remove parts that are in no list, of tasks that were killed while a failed write was cleaned up; not while others write."""
    return _remove(path, "part-", frozenset(name for name, _, _ in committed(path)))


def committed(path: str) -> list[tuple[str, int, int]]:
    """(name, records, bytes) of all parts that count; a part holds about a gigabyte."""
    store, root = pafs.FileSystem.from_uri(path)
    found = []
    for f in sorted(store.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True)), key=lambda f: f.path):
        if f.base_name.endswith(".json"):
            with store.open_input_stream(f.path, compression=None) as source:
                found += [tuple(p) for p in json.loads(source.read())["parts"]]
    return found


class CaptureReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name, _, _ in committed(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, root = pafs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{root}/parts/{partition.value}", compression=None) as source:
            unpacker, raw, left = zlib.decompressobj(31), bytearray(), b""
            while piece := left or source.read(_CHUNK):
                raw += unpacker.decompress(piece)
                left = b""
                if unpacker.eof:
                    yield parsed(bytes(raw))
                    left, unpacker, raw = unpacker.unused_data, zlib.decompressobj(31), bytearray()
            if raw:
                raise ValueError(f"{partition.value} ends within a record")


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def store_captures(captures: DataFrame, path: str, *, part_bytes: int = PART_BYTES) -> None:
    """Write the bodies that the store at ``path`` doesn't hold yet under their address, one of each.

    ``captures`` have url, status and body. Rows without a url or body, and answers that
    nothing has changed (304), hold nothing to keep. Of equal bodies of one address the one
    with the least status is kept. The store's addresses and digests are read without bodies
    being kept.
    """
    spark = captures.sparkSession
    rows = fresh_captures(captures, held(spark, path))
    rows.select("url", "raw_sha256", "status", "body").write.format("captures").mode("append").option("path", path).option("part_bytes", part_bytes).save()


def held(spark: SparkSession, path: str) -> DataFrame:
    """(url, raw_sha256) of all bodies of a store."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").option("path", path).load().select("url", "raw_sha256")


def fresh_captures(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures that are neither repeats in their batch nor stored, with raw_sha256.

    Repeats are told by numbers alone: bodies meet only their own digests.
    """
    url = F.array_join(F.filter(F.split("url", r"\s+"), lambda w: w != ""), " ")
    rows = captures.filter("url IS NOT NULL AND body IS NOT NULL AND coalesce(status, 200) <> 304").select(url.alias("url"), F.coalesce("status", F.lit(200)).cast("int").alias("status"), "body")
    rows = rows.withColumn("raw_sha256", F.sha2("body", 256))
    nth = F.row_number().over(Window.partitionBy("url", "raw_sha256").orderBy("status"))
    return rows.join(stored, ["url", "raw_sha256"], "left_anti").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
