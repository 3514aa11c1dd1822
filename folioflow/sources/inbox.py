"""Inbox of batches: a marker, a manifest and files each; checks of batches and of their items.

A batch is refused as a whole for structural faults, an item alone for its own; the first
fault counts. Batches are read as tables (``read_inbox``), so contents are hashed where they lie
and only reasons are gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import bodies

# Limits and fields of the two kinds of batches, and the first bytes of images in hexadecimal digits.
MAX_MANIFEST_BYTES = 256 * 1024
MAX_ITEM_BYTES = 16 * 1024
ITEM_FIELDS = (
    "identity", "kind", "site", "source_work_id", "source_chapter_id", "source_url", "work_title", "author", "chapter_label", "chapter_kind", "source_episode_number",
    "source_reading_position", "source_order_group", "access", "bytes", "sha256", "text_sha256", "observed_at", "board", "post_id", "category", "title", "content_lane",
    "completed_at", "relative_path", "created_at", "folder",
)
TEXT_FIELDS = ("work_title", "author", "category", "chapter_label", "chapter_kind", "access")
MEDIA_FIELDS = ("path_key", "relative_path", "content_type", "bytes", "sha256", "width", "height", "post")
IMAGES = {"image/webp": "webp", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif"}
MAGIC = {"image/webp": "^52494646.{8}57454250", "image/png": "^89504E470D0A1A0A", "image/jpeg": "^FFD8FF", "image/gif": "^47494638"}
HEX64 = r"^[0-9a-f]{64}$"


class Rules(NamedTuple):
    """What a kind of batch asks for; the functions take an item as a variant (and its content)."""

    batch_id: str
    manifest: dict[str, str]
    name: str
    identity: str
    structural: Callable[[Column, Column], Column]
    reason: Callable[[Column, Column], Column]
    max_items: int
    max_bytes: int
    max_file_bytes: int


def _is(value: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(value, F.lit(False))


def _type(item: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))


def text(item: Column, name: str) -> Column:
    """A field if it is a JSON text, else null."""
    return F.when(_type(item, name) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def whole(item: Column, name: str) -> Column:
    """A field if it is a whole JSON number, else null."""
    return F.when(_type(item, name) == "BIGINT", F.try_variant_get(item, f"$.{name}", "long"))


def _absent(item: Column, name: str) -> Column:
    return _is(_type(item, name) == "VOID") | _type(item, name).isNull()


def _secure_host(url: Column) -> Column:
    """The host of an https address without user and with the standard port, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)(?::443)?(?:[/?#].*)?$", 1)), F.lit(""))


def identity_valid(item: Column, sites: dict[str, str], board_kind: str, board_host: str, board_site: str) -> Column:
    """Whether identity, address and fields of an item agree, by its kind.

    Kinds are manual_document, novel_chapter (of one of ``sites``, a pattern of hosts each) and
    ``board_kind`` (posts of ``board_host``).
    """
    folder, host, site = text(item, "folder"), _secure_host(text(item, "source_url")), text(item, "site")
    manual = (
        _is(F.regexp_like(text(item, "identity"), F.lit(r"^manual:[a-f0-9]{64}$"))) & _is(F.length(text(item, "created_at")) <= 40)
        & F.regexp_like(F.coalesce(text(item, "created_at"), F.lit("")), F.lit(r"(?:Z|[+-]\d\d:?\d\d)$")) & text(item, "created_at").try_cast("timestamp").isNotNull()
        & _is(F.length(folder) <= 2000) & ~_is(F.regexp_like(folder, F.lit(r"^/|(?:^|/)\.\.(?:/|$)|\\|\x00"))) & _is(F.trim(text(item, "title")) != "") & _is(text(item, "source_url") == "")
    )
    pattern = F.element_at(F.create_map(*(F.lit(x) for pair in sites.items() for x in pair)), site) if sites else F.lit(None).cast("string")
    work, chapter = text(item, "source_work_id"), text(item, "source_chapter_id")
    numbers = F.regexp_like(work, F.lit(r"^\d+$")) & F.regexp_like(chapter, F.lit(r"^\d+$"))
    novel = _is(numbers & F.regexp_like(F.regexp_replace(host, r"^www\.", ""), pattern) & (text(item, "identity") == F.concat_ws(":", F.lit("novel_chapter"), site, work, chapter)))
    board, post, lane = text(item, "board"), text(item, "post_id"), text(item, "content_lane")
    fine = F.regexp_like(board, F.lit(r"^[A-Za-z0-9_-]{1,80}$")) & F.regexp_like(post, F.lit(r"^\d+$")) & lane.isin("text", "both")
    posted = _is(fine & (host == board_host) & (text(item, "identity") == F.concat_ws(":", F.lit(board_site), board, post, lane)))
    kind = text(item, "kind")
    return F.when(kind == "manual_document", manual).when(kind == "novel_chapter", novel).when(kind == board_kind, posted).otherwise(False)


def image_type(content: Column) -> Column:
    """The type that the first bytes of an image tell, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(*(F.when(F.regexp_like(head, F.lit(pattern)), name) for name, pattern in MAGIC.items()))


def _content_faults(item: Column, content: Column) -> Column:
    return F.when(content.isNull(), "content_missing").when(F.octet_length(content) != whole(item, "bytes"), "size_mismatch").when(F.sha2(content, 256) != text(item, "sha256"), "sha256_mismatch")


def media_reason(item: Column, content: Column, post: str, placeholder: str, max_file_bytes: int) -> Column:
    """Why an image of a batch isn't taken; null if it is. ``post`` is the pattern of posts' names, ``placeholder`` the hash of a refusal image."""
    kind = text(item, "content_type")
    extension = F.element_at(F.create_map(*(F.lit(x) for pair in IMAGES.items() for x in pair)), kind)
    sized = lambda name, most: _is(whole(item, name).between(1, most))
    return (
        F.when(extension.isNull(), "content_type_invalid").when(~_is(F.regexp_like(text(item, "relative_path"), F.concat(F.lit(r"^files/[0-9]{6}\."), extension, F.lit("$")))), "relative_path_type_mismatch")
        .when(~_is(F.regexp_like(text(item, "post"), F.lit(post))), "post_invalid").when(~(sized("width", 20_000) & sized("height", 20_000)), "dimensions_invalid")
        .when(~(sized("bytes", max_file_bytes) & _is(F.regexp_like(text(item, "sha256"), F.lit(HEX64)))), "content_metadata_invalid").when(text(item, "sha256") == placeholder, "placeholder_image")
        .otherwise(F.coalesce(_content_faults(item, content), F.when(~_is(image_type(content) == kind), "magic_mismatch")))
    )


def text_reason(item: Column, content: Column, valid: Column, max_file_bytes: int, max_manual_bytes: int, canonical: Callable[[Column], Column] = bodies.body_sha256) -> Column:
    """Why a text of a batch isn't taken; null if it is. ``valid`` tells whether its identity is (``identity_valid``)."""
    kind = text(item, "kind")
    raw = F.try_variant_get(item, "$.source_episode_number", "double")
    number = (kind == "novel_chapter") & F.regexp_like(_type(item, "source_episode_number"), F.lit(r"^(?:BIGINT|DOUBLE|DECIMAL)")) & (raw > 0) & (raw <= 1e12)
    placed = (kind == "novel_chapter") & whole(item, "source_reading_position").between(0, 10_000_000) & F.regexp_like(text(item, "source_order_group"), F.lit(r"^[a-f0-9]{32}$"))
    fields = F.map_keys(F.try_variant_get(item, "$", "map<string, variant>"))
    most = F.when(kind == "manual_document", max_manual_bytes).otherwise(max_file_bytes)
    titled = _type(item, "title").isNull() | _is(F.length(text(item, "title")) <= 500)
    written = content.cast("string")
    claimed = _absent(item, "text_sha256") | _is(canonical(written) == text(item, "text_sha256"))
    return (
        F.when(~_is(F.regexp_like(text(item, "relative_path"), F.lit(r"^files/[0-9]{6}\.md$"))), "relative_path_invalid")
        .when(F.size(F.array_except(fields, F.array(*map(F.lit, ITEM_FIELDS)))) > 0, "item_fields_unknown").when(~titled, "item_title_invalid").when(~_is(valid), "source_identity_invalid")
        .when(~_absent(item, "source_episode_number") & ~_is(number), "source_episode_number_invalid")
        .when(~(_absent(item, "source_reading_position") & _absent(item, "source_order_group")) & ~_is(placed), "source_reading_position_invalid")
        .when(~(_is(whole(item, "bytes").between(1, most)) & _is(F.regexp_like(text(item, "sha256"), F.lit(HEX64)))), "content_metadata_invalid")
        .otherwise(F.coalesce(
            _content_faults(item, content), F.when(~claimed, "text_sha256_mismatch"), F.when(~F.is_valid_utf8(written), "body_not_utf8"), F.when(F.contains(written, F.lit("\x00")), "body_contains_nul"),
        ))
    )


def text_structure(item: Column, raw: Column) -> Column:
    texts = F.lit(True)
    for name in TEXT_FIELDS:
        texts = texts & (_absent(item, name) | text(item, name).isNotNull())
    return F.when(F.octet_length(raw) > MAX_ITEM_BYTES, "item_metadata_too_large").when(~texts, "item_metadata_invalid")


def media_structure(item: Column, raw: Column) -> Column:
    fields = F.map_keys(F.try_variant_get(item, "$", "map<string, variant>"))
    exact = (F.size(fields) == len(MEDIA_FIELDS)) & (F.size(F.array_except(fields, F.array(*map(F.lit, MEDIA_FIELDS)))) == 0)
    key = F.regexp_like(text(item, "path_key"), F.lit(r"^[a-z0-9]{2,20}/[a-f0-9]{16,128}\.(?:png|jpe?g|webp|gif|avif)$"))
    return F.when(~exact, "item_fields_invalid").when(~_is(key), "path_key_invalid").when(~_is(F.regexp_like(text(item, "relative_path"), F.lit(r"^files/[0-9]{6}\.(?:webp|png|jpg|gif)$"))), "relative_path_invalid")


def check_batches(markers: DataFrame, manifests: DataFrame, files: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(batches, items): batch_id, state and reason; batch_id, position, identity and reason of the items of accepted ones.

    ``markers`` and ``manifests`` have batch_id and content (binary), ``files`` also name. A batch
    without a marker is not_ready, others are accepted or rejected. No table at all, and batches
    of no item, are fine input: the latter are rejected (manifest_invalid).
    """
    parsed = lambda c: F.try_parse_json(c.cast("string"))
    heads = manifests.select("batch_id", F.col("content").alias("_manifest")).join(markers.select("batch_id", F.col("content").alias("_marker")), "batch_id", "full")
    heads = heads.withColumns({"_m": parsed(F.col("_manifest")), "_r": parsed(F.col("_marker")), "_items": F.from_json(F.get_json_object(F.col("_manifest").cast("string"), "$.items"), "array<string>")})
    said = _is(whole(F.col("_m"), "schema") == 1) & _is(text(F.col("_m"), "batch_id") == F.col("batch_id")) & _is(F.size("_items").between(1, rules.max_items))
    for name, value in rules.manifest.items():
        said = said & _is(text(F.col("_m"), name) == value)
    marked = _is(whole(F.col("_r"), "schema") == 1) & _is(text(F.col("_r"), "batch_id") == F.col("batch_id"))
    fault = (
        F.when(~F.regexp_like("batch_id", F.lit(rules.batch_id)), "batch_id_invalid").when(F.col("_marker").isNull(), "not_ready").when(~marked, "ready_marker_invalid")
        .when(F.col("_manifest").isNull() | (F.octet_length("_manifest") > MAX_MANIFEST_BYTES), "manifest_invalid")
        .when(~_is(F.sha2("_manifest", 256) == text(F.col("_r"), "manifest_sha256")), "manifest_digest_mismatch").when(~said, "manifest_invalid")
    )
    heads = heads.withColumn("_fault", fault)
    items = heads.filter("_fault IS NULL").select("batch_id", F.posexplode("_items").alias("position", "_raw")).withColumn("_v", F.try_parse_json("_raw"))
    name = F.when(F.regexp_like(text(F.col("_v"), "relative_path"), F.lit(rules.name)), F.regexp_extract(text(F.col("_v"), "relative_path"), r"([^/]+)$", 1))
    items = items.withColumns({"identity": text(F.col("_v"), rules.identity), "_name": name})
    found = items.join(files.select("batch_id", F.col("name").alias("_name"), F.col("content").alias("_content"), F.lit(1).alias("_file")), ["batch_id", "_name"], "left")
    found = found.withColumn("reason", rules.reason(F.col("_v"), F.col("_content")))
    again = lambda c: F.row_number().over(Window.partitionBy("batch_id", c).orderBy("position")) > 1
    weighed = _is(whole(F.col("_v"), "bytes").between(1, rules.max_file_bytes))
    running = F.sum(F.when(weighed, whole(F.col("_v"), "bytes")).otherwise(0)).over(Window.partitionBy("batch_id").orderBy("position"))
    wrong = (
        F.when(~F.startswith(F.ltrim("_raw"), F.lit("{")) | F.col("_v").isNull(), "item_not_object").when(~_is(F.trim("identity") != "") | again("identity"), "item_identity_invalid_or_duplicate")
        .when(rules.structural(F.col("_v"), F.col("_raw")).isNotNull(), rules.structural(F.col("_v"), F.col("_raw"))).when(running > rules.max_bytes, "batch_too_large")
        .when(F.col("_name").isNotNull() & again("_name"), "duplicate_batch_path")
    )
    checked = found.select("batch_id", "position", "identity", "_name", "_file", "reason", wrong.alias("_wrong"))
    first = F.min_by("_wrong", F.when(F.col("_wrong").isNotNull(), F.struct(F.col("_wrong") == "duplicate_batch_path", "position")))
    judged = checked.groupBy("batch_id").agg(first.alias("_wrong"), F.count_distinct(F.when(F.col("_file") == 1, F.col("_name"))).alias("_listed"))
    counted = files.groupBy("batch_id").agg(F.count("*").alias("_files"))
    batches = heads.select("batch_id", "_fault").join(judged, "batch_id", "left").join(counted, "batch_id", "left")
    unlisted = F.coalesce("_files", F.lit(0)) > F.coalesce("_listed", F.lit(0))
    last = F.col("_wrong") == "duplicate_batch_path"
    reason = F.coalesce(F.col("_fault"), F.when(F.col("_files") > rules.max_items, "too_many_batch_files"), F.when(~_is(last), F.col("_wrong")), F.when(unlisted, "unlisted_batch_file"), F.col("_wrong"))
    batches = batches.select("batch_id", F.when(reason == "not_ready", "not_ready").when(reason.isNull(), "accepted").otherwise("rejected").alias("state"), F.when(reason != "not_ready", reason).alias("reason"))
    return batches, checked.join(batches.filter("state = 'accepted'").select("batch_id"), "batch_id").select("batch_id", "position", "identity", "reason")


def read_inbox(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """markers, manifests and files of the batches below ``root`` (``<batch>/ready.json``, ``manifest.json``, ``files/*``) for ``check_batches``."""
    read = lambda glob: spark.read.format("binaryFile").load(f"{root}/*/{glob}")
    batch = lambda depth: F.element_at(F.split("path", "/"), -depth)
    heads = (read(n).select(batch(2).alias("batch_id"), "content") for n in ("ready.json", "manifest.json"))
    return *heads, read("files/*").select(batch(3).alias("batch_id"), batch(1).alias("name"), "content")


def backlog(markers: DataFrame, receipts: DataFrame, lanes: dict[str, str]) -> DataFrame:
    """lane, waiting and rejected: marked batches without a receipt, and those that a receipt calls rejected.

    ``lanes`` gives the pattern of each lane's batches; ``receipts`` has batch_id and status (null: plain receipt).
    A receipt that only tells of a repair is none.
    """
    lane = F.coalesce(*(F.when(F.regexp_like("batch_id", F.lit(pattern)), name) for name, pattern in lanes.items()))
    state = receipts.groupBy("batch_id").agg(F.max(F.coalesce(F.col("status") == "rejected", F.lit(False))).alias("_rejected"), F.max(F.col("status").isNull()).alias("_done"))
    rows = markers.select("batch_id").distinct().withColumn("lane", lane).filter("lane IS NOT NULL").join(state, "batch_id", "left")
    rejected, done = F.coalesce("_rejected", F.lit(False)), F.coalesce("_done", F.lit(False))
    return rows.groupBy("lane").agg(F.count_if(~rejected & ~done).alias("waiting"), F.count_if(rejected).alias("rejected"))
