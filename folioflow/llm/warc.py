"""WARC archives: write records with an index first, then read selected records by ranges.

An archive is a file of gzip members, one record each, so any record can be read by its
byte range alone. The index (file, offset, length, URL, digest per record) is a table of
its own; readers choose rows of it and never scan archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import materialise, own_dir

#: Fixed profile of revisit records in WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def classify(pages: DataFrame, *, least_bytes: int = 1000, few_groups: int = 500_000) -> DataFrame:
    """Adds payload (null html: empty), payload_bytes, payload_sha1, record_type and refers_to.

    Of pages with equal payloads of at least ``least_bytes``, the one with the largest
    page_id is the response and the others revisit it. Repeated rows of that page_id are
    all responses, and so are pages without an id if no page of the group has one. An empty
    table gives no rows. Up to ``few_groups`` groups of copies are broadcast (some 60 bytes
    each), so that payloads stay where they are; more of them meet their pages in a shuffle.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    # Groups of copies may be large: they are aggregated before the shuffle, and only those
    # with at least two pages go into the join.
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_sha1", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
    groups = groups.filter("copies > 1").select(F.col("payload_sha1").alias("g_sha1"), F.col("payload_bytes").alias("g_bytes"), "original")
    groups = materialise(groups, "copies")
    if groups.count() <= few_groups:
        groups = F.broadcast(groups)
    rows = rows.join(groups, (F.col("payload_sha1") == F.col("g_sha1")) & (F.col("payload_bytes") == F.col("g_bytes")), "left")
    revisits = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return rows.select(
        "page_id", "url", "payload_bytes", "payload_sha1",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("original")).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def _digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _one_line(url: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", url or "")


def record(page_id, url, payload_bytes, sha1, kind, refers_to, payload, date="1970-01-01T00:00:00Z") -> bytes:
    """One WARC 1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {_digest(sha1)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_one_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """A row of ``RECORDS`` from one gzip member. Responses' digest and size come from the payload itself."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = base64.b32decode(declared).hex()
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    own = lambda name: (lambda x: int(x) if x else None)(fields.get(name, "")[1:-1].removeprefix(_ID))
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": own("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": own("WARC-Refers-To"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 1000, part_bytes: int = 1 << 30) -> DataFrame:
    """Write every page as a record to archives in ``folder`` and return the index, already stored.

    ``folder`` is a URI that all machines share, of a kind that Arrow knows (file, hdfs, s3,
    gs, abfs); other kinds that only Spark reads are an error. Each task writes files of its own under
    names that no other attempt uses, and the index has only what finished tasks report:
    a file left by a lost executor is not in it. Files are closed at ``part_bytes``.
    Null urls give records without a target; line ends in urls become a space. An empty
    table gives an empty index. Columns other than page_id, url and html are ignored.
    """
    schema = _arrow_schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None:
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(row["page_id"], row["url"], row["payload_bytes"], row["payload_sha1"], row["record_type"], row["refers_to"], row["payload"])
                    out.write(member)
                    rows.append((name, offset, len(member), row["page_id"], row["url"], row["payload_sha1"], row["record_type"]))
                    offset += len(member)
                    if offset >= part_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        finally:
            if out is not None:
                out.close()

    return materialise(classify(pages, least_bytes=least_bytes).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, *, range_bytes: int = 8 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """Read the records of the rows of ``index`` (all or some), each range of bytes at once.

    Rows are sorted by file and offset; neighbours at most ``gap_bytes`` apart within the
    same ``range_bytes`` of a file form one read. Ranges are dealt out to tasks. Repeated
    rows of the index give repeated records; a damaged record is an error; an empty index
    gives no rows. Records without a page_id have a null one.
    """
    span = Window.partitionBy("file", "block").orderBy("offset")
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / range_bytes).alias("block"))
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(span) > gap_bytes
    rows = rows.withColumn("read", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(span.rowsBetween(Window.unboundedPreceding, 0)))
    reads = rows.groupBy("file", "block", "read").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))
    schema = _arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    data = memoryview(source.read_at(row["stop"] - row["begin"], row["begin"]))
                parsed = []
                for member in row["members"]:
                    at = member["offset"] - row["begin"]
                    parsed.append(parse(data[at : at + member["length"]]))
                yield pa.RecordBatch.from_pylist(parsed, schema)

    return reads.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back.

    One row per page with its whole payload (revisits: null). Null html is an empty payload;
    null urls and page_ids stay null; repeated rows are records of their own; other columns,
    whatever their names, are ignored; an empty table gives no rows. The archives stay until
    the ``_work.temporary`` block ends.
    """
    folder = own_dir(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)


ORACLE = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
groups AS (SELECT payload_digest, max(page_id) AS original FROM rows WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM rows LEFT JOIN groups USING (payload_digest)
"""
