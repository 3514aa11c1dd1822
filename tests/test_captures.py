"""Parts of captured bodies: round trips, repeats, rotation and failing tasks."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources import captures

ROW = "url string, status int, body binary, note string"


def stored(spark, path):
    spark.dataSource.register(captures.CaptureSource)
    return sorted((r.url, r.status, bytes(r.body)) for r in spark.read.format("captures").option("path", path).load().collect())


def test_round_trip_repeats_and_parts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [(f"https://h/{i % 40}", 200, os.urandom(300) if i % 2 else b"same", "x") for i in range(200)]
    rows += [("https://h/1 \r\n2", 404, b"", None), ("https://h/big", 200, b"z" * 9_000_000, None), ("https://h/x", 304, b"no", None), (None, 200, b"no", None), ("https://h/y", None, b"y", None), ("https://h/z", 200, None, None), ("https://h/0", 299, b"same", None)]
    captures.store_captures(spark.createDataFrame(rows, ROW).repartition(3), path, part_bytes=5000)
    wanted = {}
    for url, status, body, _ in rows:
        if url is not None and body is not None and status != 304:
            key = (" ".join(url.split()), bytes(body))
            wanted[key] = min(wanted.get(key, 999), 200 if status is None else status)
    assert stored(spark, path) == sorted((u, s, b) for (u, b), s in wanted.items())
    first = captures.committed(path)
    assert len(first) > 3 and sum(n for _, n, _ in first) == len(wanted)
    captures.store_captures(spark.createDataFrame([*rows, ("https://h/new", 200, b"new", None)], ROW), path)
    assert len(stored(spark, path)) == len(wanted) + 1  # repeats are in the store already


def test_a_failing_task_leaves_no_part(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    captures.store_captures(spark.createDataFrame([("https://h/1", 200, b"a", None)], ROW), path)
    before = stored(spark, path)
    spark.conf.set("spark.sql.ansi.enabled", "true")
    bad = spark.range(400, numPartitions=4).select(
        F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url"), F.sha2(F.lit("x"), 256).alias("raw_sha256"),
        F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(200).cast("int").alias("status"), F.encode(F.lit("x"), "UTF-8").alias("body"),
    )
    with pytest.raises(Exception, match="lost"):
        bad.write.format("captures").mode("append").option("path", path).save()
    assert stored(spark, path) == before
    captures.sweep(path)  # killed tasks may end after the write was given up
    assert len(os.listdir(f"{tmp_path}/store/parts")) == len(captures.committed(path)) == 1


def test_empty_store_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert stored(spark, path) == []
    captures.store_captures(spark.createDataFrame([], ROW), path)
    assert stored(spark, path) == []
    raw = bytearray(captures.record("u", captures.hashlib.sha256(b"body").hexdigest(), 200, b"body"))
    assert captures.parsed(captures.zlib.decompress(bytes(raw), 31))[3] == b"body"
    with pytest.raises(ValueError, match="damaged"):
        captures.parsed(captures.zlib.decompress(bytes(captures.record("u", "0" * 64, 200, b"body")), 31))
