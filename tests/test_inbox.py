"""Batches read from folders, and images of a media batch."""

import hashlib
import json

from pyspark.sql import functions as F

from folioflow.plans import batches as plans
from folioflow.sources import inbox

BATCH = "20240101T000000Z-pc-0000000%d"


def _put(root, number, items, contents, digest=None):
    folder = root / (BATCH % number)
    (folder / "files").mkdir(parents=True)
    manifest = json.dumps({"schema": 1, "batch_id": folder.name, "producer": "pc", "items": items}, ensure_ascii=False).encode()
    (folder / "manifest.json").write_bytes(manifest)
    (folder / "ready.json").write_text(json.dumps({"schema": 1, "batch_id": folder.name, "manifest_sha256": digest or hashlib.sha256(manifest).hexdigest()}))
    for name, content in contents.items():
        (folder / "files" / name).write_bytes(content)


def _text(n, body, **more):
    return {
        "kind": "manual_document", "identity": f"manual:{n:064x}", "created_at": "2024-01-01T00:00:00Z", "folder": "", "title": "제목", "source_url": "", "relative_path": f"files/{n:06d}.md",
        "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(),
    } | more


def test_text_batches(spark, tmp_path):
    good, broken = "글".encode(), b"\xff\xfe"
    _put(tmp_path, 1, [_text(1, good), _text(2, broken), _text(3, good, x=1), _text(4, good, source_episode_number=1), _text(5, good, title=5)], {"000001.md": good, "000002.md": broken, "000003.md": good, "000004.md": good, "000005.md": good})
    _put(tmp_path, 2, [_text(1, good), _text(2, good, relative_path="files/000001.md")], {"000001.md": good})
    _put(tmp_path, 3, ["x"], {"000001.md": good})
    _put(tmp_path, 4, [], {"000001.md": good})
    _put(tmp_path, 5, [_text(1, good, author=3)], {"000001.md": good})
    batches, items = inbox.check_batches(*inbox.read_inbox(spark, str(tmp_path)), plans.RULES)
    assert [(r.state, r.reason) for r in batches.orderBy("batch_id").collect()] == [
        ("accepted", None), ("rejected", "duplicate_batch_path"), ("rejected", "item_not_object"), ("rejected", "manifest_invalid"), ("rejected", "item_metadata_invalid"),
    ]
    assert [r.reason for r in items.orderBy("position").collect()] == [None, "body_not_utf8", "item_fields_unknown", "source_episode_number_invalid", "item_title_invalid"]


def test_media_batches(spark):
    body = b"GIF89a" + bytes(9)
    item = {"path_key": "20240101ac/" + "a" * 16 + ".gif", "relative_path": "files/000001.gif", "content_type": "image/gif", "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "width": 1, "height": 1, "post": "h:b:1:both"}
    rules = inbox.Rules(r"^m\d$", {}, r"^files/[0-9]{6}\.\w+$", "path_key", inbox.media_structure, lambda v, c: inbox.media_reason(v, c, r"^h:b:\d+:both$", "0" * 64, 8 << 20), 200, 48 << 20, 8 << 20)
    cases = {"m1": [item], "m2": [item | {"width": 0}], "m3": [item | {"extra": 1}], "m4": [item, item | {"relative_path": "files/000002.gif"}]}
    manifests = [(k, bytearray(json.dumps({"schema": 1, "batch_id": k, "items": v}).encode())) for k, v in cases.items()]
    markers = [(k, bytearray(json.dumps({"schema": 1, "batch_id": k, "manifest_sha256": hashlib.sha256(m).hexdigest()}).encode())) for k, m in manifests]
    files = spark.createDataFrame([(k, "000001.gif", bytearray(body)) for k in cases], "batch_id string, name string, content binary")
    frame = lambda rows: spark.createDataFrame(rows, "batch_id string, content binary")
    batches, items = inbox.check_batches(frame(markers), frame(manifests), files, rules)
    assert [r.reason for r in batches.orderBy("batch_id").collect()] == [None, None, "item_fields_invalid", "item_identity_invalid_or_duplicate"]
    assert [r.reason for r in items.orderBy("batch_id").collect()] == [None, "dimensions_invalid"]
    empty = inbox.check_batches(frame([]), frame([]), files.limit(0), rules)
    assert empty[0].count() == empty[1].count() == 0


def test_image_types(spark):
    heads = [b"RIFF....WEBPx", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8", b"", None]
    rows = spark.createDataFrame([(i, h and bytearray(h) if h is not None else None) for i, h in enumerate(heads)], "i int, v binary")
    assert [r[0] for r in rows.orderBy("i").select(inbox.image_type(F.col("v"))).collect()] == ["image/webp", "image/png", "image/jpeg", "image/gif", None, None]
