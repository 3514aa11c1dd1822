"""Queries of references, guarded statuses, boundaries, retention and bins by length, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import bodies, markup, threads, titles
from folioflow.operators import coverage, merge, queue, reading
from folioflow.plans.readers import _ENTRIES, _entries


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@query("b7_recent_failures", """WITH r AS (SELECT user_id FROM (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS finished FROM events GROUP BY 1) WHERE finished IS NULL OR finished >= TIMESTAMP '2024-01-28'),
c AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND user_id IN (SELECT user_id FROM r))
SELECT 'error' AS kind, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k') AS code, count(*) AS n FROM c WHERE event_type = 'error' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'removal', NULL, event_type, count(*) FROM c WHERE event_type IN ('view', 'click') GROUP BY ALL""")
def recent_failures(spark, sf_dir):
    """Users as runs that end with their last purchase; views and clicks stand for removals."""
    events = _t(spark, sf_dir, "events")
    runs = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished"))
    captures = events.withColumn("code", F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k")))
    return coverage.failure_timeline(runs, captures, "user_id", "finished", "ts", "code", "event_type", _ntz("2024-01-28"), ["view", "click"])


@query("d8_post_references", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'free_aa' WHEN o_orderkey % 4 = 1 THEN 'aa_19' END AS board, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS post FROM orders""")
def post_references(spark, sf_dir):
    """Order keys in a short and a long address, in one of capital letters and in one without a number."""
    key, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    url = (
        F.when(form == 0, F.concat(F.lit("https://h.org/free_aa/"), key, F.lit("?page=2"))).when(form == 1, F.concat(F.lit("https://h.org/bbs/board.php?bo_table=aa_19&wr_id="), key, F.lit("#c_1")))
        .when(form == 2, F.concat(F.lit("https://h.org/Free/"), key)).otherwise(F.concat(F.lit("https://h.org/bbs/board.php?bo_table=aa&wr_id=x"), key))
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", markup.post_reference(url).alias("r")).select("o_orderkey", "r.board", "r.post")


@query("d11_categories", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS category FROM orders""")
def categories(spark, sf_dir):
    key = F.col("o_orderkey") % 3
    first = F.when(key == 0, F.concat(F.lit(" [ "), "o_orderpriority", F.lit("] "))).when(key == 1, "  ").when(key == 2, "[ ]")
    return _t(spark, sf_dir, "orders").select("o_orderkey", markup.category(first, F.col("o_orderstatus")).alias("category"))


@query("d12_image_references", """SELECT o_orderkey, 2 AS position, '/i/' || o_orderkey || '.png' AS source_url, 'https://h.org/i/' || o_orderkey || '.png' AS resolved_url, 'h.org' AS host, 'a&b' AS alt, '10' AS width FROM orders
UNION ALL SELECT o_orderkey, 4, '//K.net/' || o_orderkey || '.gif', 'https://K.net/' || o_orderkey || '.gif', 'k.net', NULL, NULL FROM orders""")
def image_references(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    html = F.concat(F.lit('<p><img><IMG alt="a&amp;b" src="/i/'), key, F.lit(".png\" width=10><img src='data:x'><script>'<img src=/no>'</script><img src='//K.net/"), key, F.lit(".gif'/><!--<img src=/no>-->"))
    found = _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(markup.image_references(html, F.concat(F.lit("https://h.org/b/"), key))).alias("i"))
    return found.select("o_orderkey", *(f"i.{c}" for c in ("position", "source_url", "resolved_url", "host", "alt", "width")))


@query("d27_series", """SELECT o_orderkey, 'A Tale of ' || o_orderpriority AS stem, CASE WHEN o_orderkey % 2 = 0 THEN '[AA] 【완】' ELSE '' END AS tags,
left(sha256(o_custkey || chr(10) || lower('A Tale of ' || o_orderpriority)), 16) AS key FROM orders""")
def series(spark, sf_dir):
    even = F.col("o_orderkey") % 2 == 0
    title = F.concat(F.when(even, " [AA] 【완】 ").otherwise(""), F.lit("A  Tale of "), "o_orderpriority", F.when(even, F.concat(F.lit(" - ("), F.col("o_orderkey").cast("string"), F.lit("어장)"))).otherwise(F.concat(F.lit("〈~"), F.col("o_orderkey").cast("string"), F.lit("〉"))))
    name = F.concat(F.when(even, "이름◆ ").otherwise(""), F.col("o_custkey").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", titles.series(title, name).alias("s")).select("o_orderkey", "s.stem", "s.tags", "s.key")


@query("d42_media_path_keys", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '20230607sac/' || left(sha256(o_orderkey::VARCHAR), 32) || '.webp' END AS path_key FROM orders""")
def media_path_keys(spark, sf_dir):
    name = F.concat(F.lit("20230607sac/"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 32))
    form = F.col("o_orderkey") % 3
    url = F.when(form == 0, F.concat(F.lit("HTTPS://ac-o.K.example:443/"), name, F.lit(".webp?expires=1"))).when(form == 1, F.concat(F.lit("https://notk.example/"), name, F.lit(".webp"))).otherwise(F.concat(F.lit("https://k.example/"), name, F.lit(".exe")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", bodies.media_path_key(url, ("k.example",)).alias("path_key"))


@query("d48_legacy_comments", """WITH c AS (SELECT l_orderkey, l_linenumber * 10 AS id, CASE WHEN l_partkey % 2 = 0 THEN (l_linenumber - 1) * 10 END AS parent_id,
CASE WHEN l_partkey % 3 = 0 THEN '-' ELSE l_returnflag END AS content, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS position FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, arg_min(l_returnflag, (l_partkey, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY ALL))
SELECT a.l_orderkey, a.id, a.position, b.position AS parent_position, a.content FROM c a LEFT JOIN c b ON a.l_orderkey = b.l_orderkey AND a.parent_id = b.id""")
def legacy_comments(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag")).alias("l"))
    rows = lines.select(
        "l_orderkey", (F.col("l_linenumber") * 10).alias("id"), F.when(F.col("l.l_partkey") % 2 == 0, (F.col("l_linenumber") - 1) * 10).alias("parent_id"),
        F.when(F.col("l.l_partkey") % 3 == 0, " \n").otherwise(F.col("l.l_returnflag")).alias("content"),
    )
    return threads.legacy_comments(rows, ["l_orderkey"], "id", "parent_id", "content", "-").select("l_orderkey", "id", "position", "parent_position", "content")


@query("f16_guarded_status", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id * 7919 % 1000003 AS arrival, CASE WHEN value > 5 THEN value END AS warning FROM events),
x AS (SELECT user_id, 0 AS fresh, NULL AS arrival, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 60 DAY ELSE ts END AS seen_at, event_type AS outcome, warning FROM e WHERE n = 1
UNION ALL SELECT user_id, 1, arrival, ts, event_type, warning FROM e WHERE n > 1 AND ts <= TIMESTAMP '2024-01-25'),
k AS (SELECT *, max(CASE WHEN seen_at <= TIMESTAMP '2024-01-25' THEN seen_at END) OVER (PARTITION BY user_id ORDER BY fresh, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM x),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fresh, arrival) AS o FROM k WHERE fresh = 0 OR best IS NULL OR seen_at >= best)
SELECT user_id, max_by(seen_at, o) AS seen_at, max_by(outcome, o) AS outcome, max_by(warning, o) FILTER (warning IS NOT NULL) AS warning FROM a GROUP BY user_id""")
def guarded_status(spark, sf_dir):
    """The first event of a user is what is stored, for some with a clock 60 days ahead; the others are reported in mixed order."""
    events = _t(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", F.col("ts").alias("seen_at"), F.col("event_type").alias("outcome"), F.when(F.col("value") > 5, F.col("value")).alias("warning"))
    first = events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    ahead = F.when(F.col("user_id") % 3 == 0, F.col("seen_at") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("seen_at"))
    stored = rows.join(first, ["user_id", "event_id"]).withColumn("seen_at", ahead).drop("event_id")
    reports = rows.join(first, ["user_id", "event_id"], "left_anti").withColumn("arrival", F.col("event_id") * 7919 % 1000003)
    return merge.guarded_status(stored, reports, "user_id", "seen_at", "arrival", ["warning"], _ntz("2024-01-25"))


@query("g18_pruned_files", """WITH f AS (SELECT doc_id, source, n_chars, TIMESTAMP '2024-01-01' - (doc_id % 1000) * INTERVAL 1 HOUR AS made_at FROM documents),
k AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY made_at DESC, n_chars DESC, doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_bytes FROM f)
SELECT doc_id, kept_bytes FROM k WHERE made_at <= TIMESTAMP '2023-12-31 14:00:00' AND (made_at < TIMESTAMP '2023-12-12' OR kept_bytes > 50000)""")
def pruned_files(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.timestamp_add("HOUR", -(F.col("doc_id") % 1000).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("made_at"))
    return queue.pruned_files(docs, ["source"], "made_at", "n_chars", "doc_id", F.lit("2024-01-01").cast("timestamp"), 20 * 86_400, 50_000, 10 * 3_600).select("doc_id", "kept_bytes")


@query("g25_boundary_pages", """WITH r AS (SELECT user_id, event_id, event_id // 200 AS page, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, max(event_id) OVER (PARTITION BY user_id) AS last FROM events),
q AS (SELECT *, n - coalesce(max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS quiet FROM r)
SELECT user_id, min(page) + 2 AS last_page FROM q WHERE CASE WHEN user_id % 2 = 0 THEN event_id >= last // 2 ELSE quiet >= 10 END GROUP BY user_id""")
def boundary_pages(spark, sf_dir):
    """Listings of newest posts first (ids fall); every other board has an anchor in its middle."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.expr("event_id div 200").alias("page"), (-F.col("event_id")).alias("id"))
    anchors = rows.filter("user_id % 2 = 0").groupBy("user_id").agg((-F.expr("max(event_id) div 2")).alias("anchor"))
    return queue.boundary_page(rows, anchors, "user_id", "page", "event_id", "id", F.col("event_type") != "purchase", run=10)


@query("j8_this_week", """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) * 30000 AS ms FROM events WHERE ts::DATE BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM d), c AS (SELECT u.user_id, i, coalesce(d.ms, 0) AS ms FROM u CROSS JOIN range(7) t(i) LEFT JOIN d ON d.user_id = u.user_id AND d.day = DATE '2024-01-15' + i::INT)
SELECT user_id, string_agg(ms::BIGINT, ',' ORDER BY i) AS days, sum(ms)::BIGINT AS total, count(*) FILTER (ms >= 60000) AS active_days FROM c GROUP BY user_id""")
def this_week(spark, sf_dir):
    daily = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.count("*") * 30_000).alias("ms"))
    week = reading.week_of(daily, ["user_id"], "day", "ms", F.lit("2024-01-18").cast("date"))
    return week.select("user_id", F.concat_ws(",", F.transform("days", lambda v: v.cast("string"))).alias("days"), "total", "active_days")


@query("j15_discovery_picks")
def discovery_picks(spark, sf_dir):
    """Orders as series of their lines, those with a line of quantity 50 begun; a draw, so without SQL."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("available"), F.sum("l_partkey").alias("views"), F.sum("l_suppkey").alias("comments"), F.max("l_quantity").alias("q"))
    works = lines.withColumn("kind", F.when(F.col("work") % 10 == 0, "oneshot").otherwise("series"))
    return reading.discovery_picks(works, lines.filter("q >= 50"), "work", "2024-01-30").select("work", "available")


@query("j16_length_bins", _ENTRIES + """, r AS (SELECT *, greatest(1, q::BIGINT) AS w FROM e),
s AS (SELECT *, row_number() OVER o AS n, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS stop, sum(w) OVER (PARTITION BY work) AS total, count(*) OVER (PARTITION BY work) AS c FROM r WINDOW o AS (PARTITION BY work ORDER BY position)),
k AS (SELECT work, c, least(3, c) AS wide, count(*) FILTER (stop * least(3, c) <= total) AS i1, count(*) FILTER (stop * least(3, c) <= total * 2) AS i2 FROM s GROUP BY work, c),
f AS (SELECT *, CASE WHEN wide > 1 THEN least(greatest(i1, 1), c - wide + 1) ELSE c END AS e1 FROM k), g AS (SELECT *, CASE WHEN wide > 2 THEN least(greatest(i2, e1 + 1), c - 1) ELSE c END AS e2 FROM f)
SELECT work, ((n > e1)::BIGINT + (n > e2)::BIGINT)::BIGINT AS bin, count(*) AS n, sum(w)::BIGINT AS length, max(CASE WHEN progress >= 0.95 THEN 2 WHEN progress IS NOT NULL THEN 1 ELSE 0 END) AS state_rank
FROM (SELECT s.work, n, w, progress, e1, e2 FROM s JOIN g USING (work)) GROUP BY ALL""")
def length_bins(spark, sf_dir):
    state = F.when(F.col("progress") >= 0.95, 2).when(F.col("progress").isNotNull(), 1).otherwise(0)
    return reading.length_bins(_entries(spark, sf_dir), "work", "position", F.col("q"), state, 3)
