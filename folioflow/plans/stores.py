"""Queue, merge and release queries over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import text as tx
from folioflow.operators import merge, queue, release


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queue(spark, sf_dir):
    """Orders as a queue: nation is the board, the region its group, P waits for a retry, F has a body."""
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_nationkey").alias("board"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("has_body"),
        F.when(F.col("o_orderstatus") == "P", "retry").otherwise("pending").alias("state"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.day("o_orderdate").alias("attempts"), F.col("n_regionkey").alias("board_group"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"),
        F.lit(None).cast("timestamp").alias("lease_expires_at"),
    )


_QUEUE = """WITH q AS (SELECT c_nationkey AS board, o_orderkey AS id, o_orderstatus = 'F' AS has_body, CASE WHEN o_orderstatus = 'P' THEN 'retry' ELSE 'pending' END AS state,
  6 - substr(o_orderpriority, 1, 1)::INT AS priority, day(o_orderdate)::INT AS attempts, n_regionkey AS board_group, o_orderdate AS next_attempt_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) """


@query("g4_claim_batch", _QUEUE + """SELECT board, id, attempts + 1 AS attempts FROM q WHERE next_attempt_at <= TIMESTAMP '1998-01-01' ORDER BY priority DESC, board, id LIMIT 100""")
def claim_batch(spark, sf_dir):
    return queue.claim(_queue(spark, sf_dir), F.lit("1998-01-01").cast("timestamp"), 100).select("board", "id", "attempts")


@query("g5_recovery_order", _QUEUE + """, r AS (SELECT *, has_body::INT AS body_rank, CASE WHEN state = 'retry' THEN 0 ELSE 1 END AS state_rank FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY body_rank, state_rank, priority DESC, attempts, id)::INT AS board_rank FROM r)
SELECT board, id, board_rank FROM b ORDER BY body_rank, b.board_rank, state_rank, board_group, priority DESC, attempts, board, id LIMIT 200""")
def recovery_order(spark, sf_dir):
    return queue.recovery_order(_queue(spark, sf_dir), 200).select("board", "id", "board_rank")


@query("g5_recovery_missing", _QUEUE + """, r AS (SELECT *, CASE WHEN state = 'pending' THEN 0 ELSE 1 END AS state_rank FROM q WHERE NOT has_body),
b AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY state_rank, priority DESC, attempts, id)::INT AS board_rank FROM r)
SELECT board, id, board_rank FROM b ORDER BY b.board_rank, state_rank, board_group, priority DESC, attempts, board, id LIMIT 200""")
def recovery_missing(spark, sf_dir):
    return queue.recovery_order(_queue(spark, sf_dir), 200, missing_only=True).select("board", "id", "board_rank")


@query("g8_stale_revisit", """SELECT c_custkey, max(o_orderdate) AS collected_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey ORDER BY collected_at NULLS FIRST, c_custkey LIMIT 50""")
def stale_revisit(spark, sf_dir):
    last = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("collected_at"))
    rows = _t(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "collected_at").orderBy(F.asc_nulls_first("collected_at"), "c_custkey").limit(50)


@query("g12_failed_state", """SELECT event_id, a AS attempts, least(21600, 120 * (2 ** (a - 1)))::BIGINT AS delay,
CASE WHEN (event_type = 'error' AND a >= 5) OR (event_type = 'click' AND a >= 24) THEN 'dead' ELSE 'retry' END AS state
FROM (SELECT *, 1 + json_extract_string(props, '$.k')::BIGINT AS a FROM events)""")
def failed_state(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("attempts", 1 + F.get_json_object("props", "$.k").cast("long"))
    state = queue.failed_state(F.col("attempts"), F.col("event_type"), ["error"], ["click"])
    return rows.select("event_id", "attempts", queue.retry_delay(F.col("attempts")).alias("delay"), state.alias("state"))


@query("g13_sweep", """WITH o AS (SELECT doc_id, source FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'moved' ELSE source END AS source FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.source IS NOT DISTINCT FROM n.source THEN 'keep' ELSE 'update' END AS action
FROM o FULL JOIN n USING (doc_id)""")
def sweep(spark, sf_dir):
    """The stored and the reported generation are two derived states of the same table."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    reported = docs.filter("lang <> 'es'").withColumn("source", F.when(F.col("lang") == "fr", "moved").otherwise(F.col("source")))
    return queue.sweep(docs.filter("lang <> 'de'"), reported, "doc_id", ["source"])


@query("g17_expired_runs", """SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-04-10' - CASE WHEN event_type = 'error' THEN INTERVAL 90 DAY ELSE INTERVAL 80 DAY END""")
def expired_runs(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return queue.expired_runs(events, F.lit("2024-04-10").cast("timestamp"), "ts", F.col("event_type") == "error", 80, 90).select("event_id", "event_type")


@query("g18_over_budget", """SELECT doc_id, kept_bytes::BIGINT AS kept_bytes FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS kept_bytes FROM documents) WHERE kept_bytes > 50000""")
def over_budget(spark, sf_dir):
    return queue.over_budget(_t(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 50000).select("doc_id", "kept_bytes")


@query("g25_first_boundary", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
q AS (SELECT *, n - coalesce(max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS quiet FROM r)
SELECT user_id, min(event_id) AS boundary FROM q WHERE quiet = 10 GROUP BY user_id""")
def first_boundary(spark, sf_dir):
    return queue.first_boundary(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "purchase", 10)


@query("f2_store_posts", """WITH c AS (SELECT user_id, event_id, ts, value, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, count(DISTINCT v) AS n_versions, count(*) FILTER (n = 1 OR v IS DISTINCT FROM p) AS changes, arg_max(v, event_id) AS latest_version, max(value) AS views, max(ts) AS last_seen_at, count(*) AS captures FROM c GROUP BY user_id""")
def store_posts(spark, sf_dir):
    return merge.fold_captures(_t(spark, sf_dir, "events"), "user_id", F.col("event_type"), "ts", "event_id", "value")


@query("f5_availability", """WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1),
c AS (SELECT user_id, any_value(last) AS last, count(DISTINCT ts::DATE) FILTER (event_type = 'error' AND (last IS NULL OR event_id > last)) AS missing_runs FROM events JOIN l USING (user_id) GROUP BY 1)
SELECT user_id, missing_runs, CASE WHEN missing_runs >= 2 THEN 'missing' WHEN last IS NOT NULL THEN 'available' ELSE 'unknown' END AS availability FROM c""")
def availability(spark, sf_dir):
    """A day of a user's events is a run."""
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return merge.availability(events, "user_id", "day", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("f6_listing_outcomes", """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1 THEN 'stored' ELSE 'unchanged' END AS outcome FROM documents""")
def listing_outcomes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("sha"))
    return merge.repeats(docs, ["sha"], "doc_id").select("doc_id", "outcome")


@query("f8_import_batch", """WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) h, sha256(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) c FROM documents WHERE lang <> 'de'),
i AS (SELECT doc_id, source, CASE WHEN lang = 'fr' THEN replace(coalesce(text, ''), ' ', '  ') WHEN lang = 'es' THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS text FROM documents)
SELECT i.doc_id, CASE WHEN o.doc_id IS NULL THEN 'accepted' WHEN o.h = sha256(i.text) THEN 'duplicate' WHEN o.c = sha256(regexp_replace(i.text, '\\s+', ' ', 'g')) THEN 'equivalent_duplicate'
  WHEN i.source = 'src0' THEN 'replaced' ELSE 'held_conflict' END AS status FROM i LEFT JOIN o USING (doc_id)""")
def import_batch(spark, sf_dir):
    """A batch that repeats all documents, some of them with other spaces or an added sign."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    new = F.when(F.col("lang") == "fr", F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))

    def hashed(rows):
        return rows.select("doc_id", "source", F.sha2("text", 256).alias("raw"), F.sha2(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), 256).alias("canonical"))

    return merge.import_batch(hashed(docs.filter("lang <> 'de'")), hashed(docs.withColumn("text", new)), "doc_id", "raw", "canonical", F.col("source").eqNullSafe("src0"))


@query("f12_threads", """SELECT conv_id, max(turn) AS last_turn, count(*) AS responses, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def threads(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("responses"), F.max_by("role", "turn").alias("last_role"))


@query("f15_publication", """WITH o AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), n AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT k, coalesce(n.s, o.s)::BIGINT AS sha, CASE WHEN o.s IS NOT NULL AND (n.s IS NULL OR o.s = n.s) THEN 'old' ELSE 'new' END AS verified_at FROM n FULL JOIN o USING (k)""")
def publication(spark, sf_dir):
    """Sums of quantities stand for hashes, and old and new for the times of verification."""
    lines = _t(spark, sf_dir, "lineitem")

    def records(rows, at):
        return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("sha")).withColumn("verified_at", F.lit(at))

    return merge.publish(records(lines.filter("l_linenumber < 4"), "old"), records(lines, "new"), "k", "sha", "verified_at")


@query("f16_board_status", """SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS outcome, arg_max(value, event_id) FILTER (value > 5) AS warning FROM events GROUP BY user_id""")
def board_status(spark, sf_dir):
    """Later reports win field by field; here a view carries no outcome and a small value no warning."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("outcome"), F.when(F.col("value") > 5, F.col("value")).alias("warning"))
    return merge.latest_values(rows, ["user_id"], ["outcome", "warning"], "event_id")


@query("f18_first_events", """SELECT user_id, day, event_id FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def first_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("h2_row_hashes", """SELECT doc_id, sha256(concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || lang, '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))) AS sha FROM documents""")
def row_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", release.row_hash(*map(F.col, ("doc_id", "lang", "source", "text"))).alias("sha"))


@query("h3_nested_orders", """SELECT o_orderkey, coalesce(len(s), 0)::BIGINT AS n, coalesce(array_to_string(s, ','), '') AS parts FROM orders
LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def nested_orders(spark, sf_dir):
    rows = release.nested(
        _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), _t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"], "lines"
    )
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), F.size("lines").cast("long").alias("n"), F.array_join(F.col("lines.l_partkey").cast("array<string>"), ",").alias("parts"))


@query("h6_change_set", """WITH o AS (SELECT o_orderkey AS k, o_totalprice::VARCHAR AS s FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE o_totalprice::VARCHAR END AS s FROM orders WHERE o_orderstatus <> 'O')
SELECT k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (k) WHERE o.s IS DISTINCT FROM n.s""")
def change_set(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("string").alias("s"), "o_orderstatus", "o_orderpriority")
    new = orders.filter("o_orderstatus <> 'O'").withColumn("s", F.when(F.col("o_orderpriority") == "5-LOW", "x").otherwise(F.col("s")))
    return release.change_set(orders.filter("o_orderstatus <> 'P'"), new, "k", "s")


@query("h9_publish_delta", """SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber IN (2, 3) AND l_returnflag = 'R'""")
def publish_delta(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return release.publish_delta(lines.filter("l_linenumber IN (2, 3) AND l_returnflag = 'R'"), lines.filter("l_linenumber = 1"), "l_partkey")


@query("h12_garbage", """SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 49 AND l_partkey IS NOT NULL)""")
def garbage(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")  # releases hold what was sold in quantity
    return release.garbage(_t(spark, sf_dir, "part"), [lines.filter("l_returnflag = 'A' AND l_quantity >= 49"), lines.filter("l_returnflag = 'R' AND l_quantity >= 49")], "p_partkey", F.col("p_size") > 10).select("p_partkey")


@query("h14_text_pages", """WITH r AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS sha, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS page FROM documents)
SELECT source, page, count(*) AS n, sha256(string_agg(sha, chr(10) ORDER BY doc_id)) AS page_sha256 FROM r GROUP BY source, page""")
def text_pages(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", tx.content_hash(F.col("text")).alias("sha"))
    return release.text_pages(docs, ["source"], [F.col("doc_id")], 20, "sha")


@query("h18_entry_view", """WITH w AS (SELECT l_orderkey, max(l_linenumber) = count(*) AND min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'missing' ELSE 'available' END AS availability, contiguous FROM lineitem JOIN w USING (l_orderkey)
LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey""")
def entry_view(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return release.entry_view(_t(spark, sf_dir, "lineitem"), parts, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "availability", "contiguous")
