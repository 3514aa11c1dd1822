"""Queries of the archive engine over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import text as tx
from folioflow.operators import reading, relational, search


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("b2_open_orders_by_nation", """
SELECT n_name, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING n_open > 0 ORDER BY n_open DESC, n_done DESC, n DESC, n_name LIMIT 20""")
def open_orders_by_nation(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy("n_name").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.count("*").alias("n"))
    return counts.filter("n_open > 0").orderBy(F.desc("n_open"), F.desc("n_done"), F.desc("n"), "n_name").limit(20)


@query("b4_latest_event_per_user", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1""")
def latest_event(spark, sf_dir):
    return relational.latest_per(_t(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("b6_run_counters", """
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS stored, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def run_counters(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("stored"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("b7_failure_timeline", """
SELECT strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k') AS code, count(*) AS n FROM events
WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY ALL""")
def failure_timeline(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    buyers = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("buyer"))
    failed = events.filter("event_type = 'error'").join(buyers, F.col("user_id") == F.col("buyer"), "left_semi")
    return failed.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").alias("code")).agg(F.count("*").alias("n"))


@query("b8_label_coverage", """
SELECT count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_coverage(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("labelled").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("b16_lines_per_order", """
SELECT o_orderkey, coalesce(n, 0)::BIGINT AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def lines_per_order(spark, sf_dir):
    counts = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return _t(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("b17_unlinked_customers", """
SELECT count(DISTINCT c_custkey) AS customers, count(DISTINCT c_custkey) FILTER (o_orderkey IS NULL) AS without_orders, count(o_orderkey) AS orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def unlinked_customers(spark, sf_dir):
    per = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # one row per customer: no distinct counts are needed
    rows = _t(spark, sf_dir, "customer").select("c_custkey").distinct().join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.agg(F.count("*").alias("customers"), F.count_if(F.col("n").isNull()).alias("without_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("b21_hash_shards", "SELECT doc_id % 64 AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def hash_shards(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(64)).alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("b22_labelled_overlap", """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS in_both,
  (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left,
  (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right""")
def labelled_overlap(spark, sf_dir):
    return relational.overlap(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("b25_state_counts", "SELECT concat_ws(':', source, lang) AS state, count(*) AS n FROM documents GROUP BY 1")
def state_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.concat_ws(":", "source", "lang").alias("state")).agg(F.count("*").alias("n"))


@query("b27_recovered_at", """
SELECT e.user_id, e.event_id, e.ts AS failed_at, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (e.ts, e.event_id)) AS recovered_at
FROM events e WHERE e.event_type = 'error'""")
def recovered_at(spark, sf_dir):
    return relational.recovered_at(_t(spark, sf_dir, "events"), "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase", ["user_id"])


@query("b29_keyset_page", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 10) OR o_totalprice IS NULL ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 51""")
def keyset_page(spark, sf_dir):
    return relational.keyset_page(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", (200000.0, 10), 51).select("o_orderkey", "o_totalprice")


@query("b33_unique_content_links", """
WITH d AS (SELECT doc_id, source, sha256(text) h, count(*) OVER (PARTITION BY source, sha256(text)) c FROM documents)
SELECT l.doc_id AS left_id, r.doc_id AS right_id FROM d l JOIN d r ON l.h = r.h AND l.source < r.source WHERE l.c = 1 AND r.c = 1""")
def unique_content_links(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", tx.content_hash(F.col("text")).alias("h"))
    single = docs.groupBy("source", "h").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id")).filter("n = 1")
    left, right = single.select("h", F.col("source").alias("l_source"), F.col("doc_id").alias("left_id")), single.select("h", F.col("source").alias("r_source"), F.col("doc_id").alias("right_id"))
    return left.join(right, "h").filter("l_source < r_source").select("left_id", "right_id")


@query("b37_unlabelled_pending", "SELECT count(*) AS pending FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_pending(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("pending"))


@query("b56_top_reasons", "SELECT event_type AS reason, count(*) AS n FROM events WHERE value > 10 GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def top_reasons(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter("value > 10").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(3)


@query("c2_token_search", """
SELECT doc_id, source FROM documents WHERE contains(regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g'), 'license') AND contains(regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g'), 'under')""")
def token_search(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(tx.contains_words(tx.searchable(F.col("text")), "license under")).select("doc_id", "source")


@query("c4_page_around", """
WITH m AS (SELECT doc_id AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents WHERE lang = 'en'),
p AS (SELECT *, lag(id) OVER (ORDER BY position) AS previous_id, lead(id) OVER (ORDER BY position) AS next_id, position // 20 AS page FROM m)
SELECT id, n_chars, position, previous_id, next_id, page FROM p WHERE page = (SELECT page FROM p ORDER BY id LIMIT 1 OFFSET 5)""")
def page_around(spark, sf_dir):
    english = _t(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "n_chars")
    sixth = english.orderBy("id").limit(6).agg(F.max("id").alias("id")).first()["id"]
    return search.page_around(english, "n_chars", "id", size=20, around=sixth)


@query("c5_facets", """
WITH s AS (SELECT source, upper(lang) AS facet, lang AS spelling, count(*) n FROM documents GROUP BY ALL)
SELECT source, facet, sum(n)::BIGINT AS n, arg_max(spelling, (n, spelling)) AS label FROM s GROUP BY ALL""")
def facets(spark, sf_dir):
    return search.facets(_t(spark, sf_dir, "documents"), ["source"], F.col("lang"), F.upper("lang"))


@query("e4_content_groups", "SELECT sha256(coalesce(text, '')) AS content_sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_groups(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(tx.content_hash(F.col("text")).alias("content_sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("f13_thread_segments", "SELECT conv_id, turn // 2 AS segment, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def thread_segments(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("segment")).agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("g4_fair_queue", """
SELECT c_nationkey, o_orderkey, r AS turn FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT r
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O') WHERE r <= 5""")
def fair_queue(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    turn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey"))
    return rows.withColumn("turn", turn).filter("turn <= 5").select("c_nationkey", "o_orderkey", "turn")


@query("h2_release_digest", "SELECT source, count(*) AS n, sum(('0x' || substr(sha256(coalesce(text, '')), 1, 8))::BIGINT)::BIGINT AS content_sum FROM documents GROUP BY source")
def release_digest(spark, sf_dir):
    """A check sum per source that does not depend on the order of its documents."""
    head = F.conv(F.substring(tx.content_hash(F.col("text")), 1, 8), 16, 10).cast("long")
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(head).alias("content_sum"))


@query("j2_daily_totals", "SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_totals(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("j3_active_time", """
WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 AS b FROM events),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM o),
u AS (SELECT user_id, k, min(a) a, max(b) b FROM g GROUP BY ALL) SELECT user_id, count(*) AS spans, sum(b - a)::BIGINT AS seconds FROM u GROUP BY user_id""")
def active_time(spark, sf_dir):
    spans = _t(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 3600)
    return reading.interval_union(spans, ["user_id"], "a", "b").groupBy("user_id").agg(F.count("*").alias("spans"), F.sum(F.col("b") - F.col("a")).alias("seconds"))


@query("j5_streaks", """
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS k FROM d)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, k""")
def streaks(spark, sf_dir):
    return reading.day_streaks(_t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")


@query("k1_last_writer", """
SELECT user_id, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL HAVING arg_max(event_type, (ts, event_id)) <> 'error'""")
def last_writer(spark, sf_dir):
    """Last writer wins per key; a key whose last entry is a tombstone (error) is gone."""
    last = relational.latest_per(_t(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return last.filter("event_type <> 'error'").select("user_id", F.col("event_type").alias("key"), "value")
