"""Queries of the inbox over batches made of orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.sources import inbox


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = inbox.Rules(
    r"^\d{8}T\d{6}Z-pc-[a-f0-9]{8}$", {"producer": "pc"}, r"^files/[0-9]{6}\.md$", "identity", inbox.text_structure,
    lambda v, content: inbox.text_reason(v, content, inbox.identity_valid(v, {}, "post", "h.org", "h"), 2 << 20, 64 << 20), 100, 64 << 20, 64 << 20,
)


def _inbox(spark, sf_dir):
    """A batch of every customer's orders as written documents; the faults go by the keys."""
    case, batch = F.col("o_custkey") % 6, F.concat(F.lit("20240101T000000Z-pc-"), F.lpad(F.lower(F.hex("o_custkey")), 8, "0"))
    body = F.when(F.col("o_orderkey") % 5 == 4, F.concat("o_orderpriority", F.lit("\x00"))).otherwise(F.col("o_orderpriority"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))  # six digits of the key may stand twice in a batch
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", case.alias("case"), batch.alias("batch_id"), body.cast("binary").alias("content"), F.concat(F.lpad(place.cast("string"), 6, "0"), F.lit(".md")).alias("name"))
    kind, key = F.col("o_orderkey") % 5, F.when(F.col("case") == 3, F.col("o_custkey")).otherwise(F.col("o_orderkey"))
    item = F.struct(
        F.lit("manual_document").alias("kind"), F.concat(F.lit("manual:"), F.sha2(key.cast("string"), 256)).alias("identity"), F.lit("2024-01-01T00:00:00+09:00").alias("created_at"),
        F.when(kind == 1, "/abs").otherwise("a/b").alias("folder"), F.lit("T").alias("title"), F.lit("").alias("source_url"), F.concat(F.lit("files/"), "name").alias("relative_path"),
        (F.octet_length("content") + F.when(kind == 2, 1).otherwise(0)).alias("bytes"), F.when(kind == 3, F.sha2(F.lit(b""), 256)).otherwise(F.sha2("content", 256)).alias("sha256"),
    )
    rows = rows.withColumn("item", item)
    manifests = rows.groupBy("batch_id", "o_custkey", "case").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "item")))["item"].alias("items"))
    manifests = manifests.select("batch_id", "case", F.to_json(F.struct(F.lit(1).alias("schema"), "batch_id", F.lit("pc").alias("producer"), "items")).cast("binary").alias("content"))
    digest = F.when(F.col("case") == 2, F.sha2(F.lit(b""), 256)).otherwise(F.sha2("content", 256))
    markers = manifests.filter("case <> 1").select("batch_id", F.to_json(F.struct(F.lit(1).alias("schema"), "batch_id", digest.alias("manifest_sha256"))).cast("binary").alias("content"))
    extra = manifests.filter("case = 4").select("batch_id", F.lit("x.md").alias("name"), F.lit(b"").alias("content"))
    return markers, manifests.select("batch_id", "content"), rows.select("batch_id", "name", "content").unionByName(extra)


_BATCHES = """WITH b AS (SELECT o_custkey, '20240101T000000Z-pc-' || lpad(lower(to_hex(o_custkey)), 8, '0') AS batch_id, o_custkey % 6 AS k, count(*) AS n FROM orders GROUP BY o_custkey),
s AS (SELECT batch_id, o_custkey, CASE WHEN k = 1 THEN 'not_ready' WHEN k IN (2, 4) OR k = 3 AND n > 1 THEN 'rejected' ELSE 'accepted' END AS state,
CASE k WHEN 2 THEN 'manifest_digest_mismatch' WHEN 3 THEN CASE WHEN n > 1 THEN 'item_identity_invalid_or_duplicate' END WHEN 4 THEN 'unlisted_batch_file' END AS reason FROM b)"""


@query("a12_batches", _BATCHES + "SELECT batch_id, state, reason FROM s")
def batches(spark, sf_dir):
    return inbox.check_batches(*_inbox(spark, sf_dir), RULES)[0]


@query("a12_items", _BATCHES + """SELECT batch_id, (row_number() OVER (PARTITION BY batch_id ORDER BY o_orderkey) - 1)::INT AS position,
CASE o_orderkey % 5 WHEN 1 THEN 'source_identity_invalid' WHEN 2 THEN 'size_mismatch' WHEN 3 THEN 'sha256_mismatch' WHEN 4 THEN 'body_contains_nul' END AS reason
FROM orders JOIN s USING (o_custkey) WHERE state = 'accepted'""")
def batch_items(spark, sf_dir):
    return inbox.check_batches(*_inbox(spark, sf_dir), RULES)[1].drop("identity")


@query("a13_identities", "SELECT o_orderkey, o_orderkey % 8 IN (0, 4) AS valid FROM orders")
def identities(spark, sf_dir):
    """Chapters and posts: fine, of another host, of another number, and with a user in the address."""
    key, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 8
    host = F.when(form.isin(1, 5), "x.org").when(form.isin(3, 7), "me@n1.org").when(form < 4, "www.N1.org").otherwise("h.org")
    item = F.to_json(F.struct(
        F.when(form < 4, "novel_chapter").otherwise("post").alias("kind"), F.lit("n").alias("site"), F.lit("7").alias("source_work_id"), key.alias("source_chapter_id"), F.concat(F.lit("https://"), host, F.lit("/a")).alias("source_url"),
        F.lit("b_1").alias("board"), key.alias("post_id"), F.lit("both").alias("content_lane"),
        F.concat(F.when(form < 4, F.concat(F.lit("novel_chapter:n:7:"), key)).otherwise(F.concat(F.lit("h:b_1:"), key, F.lit(":both"))), F.when(form.isin(2, 6), "0").otherwise("")).alias("identity"),
    ))
    return _t(spark, sf_dir, "orders").select("o_orderkey", inbox.identity_valid(F.parse_json(item), {"n": r"^n\d*\.org$"}, "post", "h.org", "h").alias("valid"))


@query("a14_image_reasons", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'content_type_invalid' WHEN 2 THEN 'relative_path_type_mismatch' WHEN 3 THEN 'post_invalid' WHEN 4 THEN 'dimensions_invalid'
WHEN 5 THEN 'content_missing' WHEN 6 THEN 'sha256_mismatch' WHEN 7 THEN 'magic_mismatch' END AS reason FROM orders""")
def image_reasons(spark, sf_dir):
    form = F.col("o_orderkey") % 8
    content = F.when(form != 5, F.concat(F.when(form == 7, F.unhex(F.lit("FFD8FF00"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A"))), F.col("o_orderpriority").cast("binary")))
    item = F.to_json(F.struct(
        F.when(form == 1, "text/html").otherwise("image/png").alias("content_type"), F.when(form == 2, "files/000001.gif").otherwise("files/000001.png").alias("relative_path"),
        F.when(form == 3, "h:b:0:both").otherwise("h:b:1:both").alias("post"), F.when(form == 4, 0).otherwise(20000).alias("width"), F.lit(1).alias("height"),
        F.coalesce(F.octet_length(content), F.lit(1)).alias("bytes"), F.sha2(F.when(form == 6, F.lit(b"")).otherwise(F.coalesce(content, F.lit(b""))), 256).alias("sha256"),
    ))
    reason = inbox.media_reason(F.parse_json(item), content, r"^h:[A-Za-z0-9_-]{1,80}:[1-9][0-9]{0,12}:(?:text|both)$", "0" * 64, 8 << 20)
    return _t(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("b57_backlog", """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'media' END AS lane FROM orders WHERE o_orderkey % 3 <> 0)
SELECT lane, count(*) FILTER (o_orderkey % 5 IN (0, 3, 4)) AS waiting, count(*) FILTER (o_orderkey % 5 = 1) AS rejected FROM m GROUP BY lane""")
def backlog(spark, sf_dir):
    """Two of three orders are marked batches; by the key one is rejected, done, in repair or untouched."""
    lane = F.when(F.col("o_orderkey") % 3 == 0, "other").when(F.col("o_orderkey") % 2 == 0, "text").otherwise("media")
    markers = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(lane, F.lit("-"), F.col("o_orderkey").cast("string")).alias("batch_id"))
    receipts = markers.filter("o_orderkey % 5 IN (1, 2, 3)").select("batch_id", F.when(F.col("o_orderkey") % 5 == 1, "rejected").when(F.col("o_orderkey") % 5 == 3, "receipt_repair").alias("status"))
    return inbox.backlog(markers, receipts, {"text": r"^text-\d+$", "media": r"^media-\d+$"})
