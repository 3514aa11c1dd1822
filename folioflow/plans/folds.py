"""Queries of folds into the store, the queue, works, releases, reading and sync, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import text as tx
from folioflow.operators import merge, queue, reading, relational, release, sync, works


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("long")


K = "json_extract_string(props, '$.k')::BIGINT"
NOW = "2024-01-20"


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@query("f1_discover_posts", """WITH s AS (SELECT doc_id, source AS title, lang AS author, lang AS category, NULL AS created_at, n_chars AS n, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS version, TIMESTAMP '2024-01-01' AS first_seen_at, TIMESTAMP '2024-01-02' AS last_seen_at FROM documents WHERE doc_id % 5 <> 0),
l AS (SELECT doc_id, 'new ' || source AS title, CASE WHEN lang <> 'de' THEN 'a ' || lang END AS author, NULL AS category, lang AS created_at, n_chars + 1 AS n, TIMESTAMP '2024-02-01' AS at FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN version IS NULL AND l.at IS NOT NULL THEN coalesce(l.title, s.title) ELSE s.title END AS title, coalesce(l.author, s.author) AS author, coalesce(l.category, s.category) AS category, coalesce(l.created_at, s.created_at) AS created_at,
 CASE WHEN l.at IS NOT NULL THEN l.n ELSE s.n END AS n, coalesce(s.first_seen_at, l.at) AS first_seen_at, greatest(s.last_seen_at, l.at) AS last_seen_at FROM s FULL JOIN l USING (doc_id)""")
def discover_posts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    stored = docs.filter("doc_id % 5 <> 0").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("author"), F.col("lang").alias("category"), nothing.alias("created_at"), F.col("n_chars").alias("count"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("latest_version_id"), _ntz("2024-01-01").alias("first_seen_at"), _ntz("2024-01-02").alias("last_seen_at"),
    )
    listed = docs.filter("doc_id % 3 <> 0").select(
        "doc_id", F.concat(F.lit("new "), "source").alias("title"), F.when(F.col("lang") != "de", F.concat(F.lit("a "), "lang")).alias("author"), nothing.alias("category"), F.col("lang").alias("created_at"),
        (F.col("n_chars") + 1).alias("count"), _ntz("2024-02-01").alias("at"),
    )
    return merge.discover(stored, listed, ["doc_id"], "at").drop("latest_version_id").withColumnRenamed("count", "n")


@query("f3_replace_comments", """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT l_orderkey, l_partkey, l_quantity AS quantity FROM lineitem WHERE l_orderkey NOT IN (FROM c)
UNION ALL SELECT l_orderkey, l_partkey, -l_quantity FROM lineitem WHERE l_orderkey IN (FROM c)""")
def replace_comments(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    changed = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    incoming = lines.withColumn("quantity", -F.col("quantity")).drop("l_linenumber")
    return merge.replace_children(lines.drop("l_linenumber"), incoming, changed, "l_orderkey")


@query("f4_unmodified", """SELECT c_custkey, greatest(TIMESTAMP '1997-01-01', max(o_orderdate)) AS last_seen_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def unmodified(spark, sf_dir):
    stored = _t(spark, sf_dir, "customer").select("c_custkey", _ntz("1997-01-01").alias("last_seen_at"))
    seen = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("at"))
    return merge.touch(stored, seen, "c_custkey", ["last_seen_at"], "at")


@query("f7_overwrite", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN NULL ELSE source END AS source, n_chars FROM documents""")
def overwrite(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.lit(1).alias("seq"))
    incoming = docs.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("source", F.lit(None).cast("string"))
    return merge.overwrite(docs, incoming, ["doc_id"], "seq").select("doc_id", "source", "n_chars")


@query("f9_keep_filled", """SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END), ''), lang) AS name, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS slug FROM documents""")
def keep_filled(spark, sf_dir):
    ident = F.col("doc_id")
    return _t(spark, sf_dir, "documents").select("doc_id", merge.keep_filled(F.col("lang"), F.when(ident % 2 == 0, " ").otherwise(F.col("source"))).alias("name"), merge.keep_first(F.when(ident % 3 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("slug"))


@query("f14_segments", """WITH o AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha FROM conversations WHERE turn < 3 AND conv_id % 4 <> 0 GROUP BY 1), n AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN o.sha IS NULL THEN 'created' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'updated' END AS outcome, CASE WHEN o.sha <> n.sha THEN o.sha END AS superseded FROM n LEFT JOIN o USING (conv_id)""")
def segments(spark, sf_dir):
    def built(turns):
        return turns.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("sha"))

    turns = _t(spark, sf_dir, "conversations")
    return merge.segment_outcomes(built(turns.filter("turn < 3 AND conv_id % 4 <> 0")), built(turns), "conv_id", "sha")


@query("f20_add_missing", "SELECT DISTINCT o_custkey AS board, 'old' AS origin FROM orders UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def add_missing(spark, sf_dir):
    """Customers that have no order yet are added to those that have."""
    known = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("board")).distinct().withColumn("origin", F.lit("old"))
    return merge.add_missing(known, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("board"), F.lit("new").alias("origin")), ["board"])


@query("f21_episode_bodies", """WITH e AS (SELECT doc_id, doc_id % 10 = 0 AS paid, CASE WHEN doc_id % 3 <> 0 THEN sha256(coalesce(text, '')) END AS old, sha256(CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || ' ' WHEN doc_id % 7 = 0 THEN 'other' ELSE coalesce(text, '') END) AS new, sha256(trim(coalesce(text, ''), ' ')) AS oc, sha256(CASE WHEN doc_id % 4 = 0 OR doc_id % 7 <> 0 THEN trim(coalesce(text, ''), ' ') ELSE 'other' END) AS nc FROM documents)
SELECT doc_id, CASE WHEN paid THEN 'waiting' WHEN old IS NULL THEN 'imported' WHEN old = new OR oc = nc THEN 'kept' ELSE 'held_conflict' END AS outcome FROM e""")
def episode_bodies(spark, sf_dir):
    text, ident = F.coalesce("text", F.lit("")), F.col("doc_id")
    new = F.when(ident % 4 == 0, F.concat(text, F.lit(" "))).when(ident % 7 == 0, "other").otherwise(text)
    sha = lambda x: F.sha2(x, 256)
    rows = _t(spark, sf_dir, "documents")
    return rows.select("doc_id", merge.episode_outcome(ident % 10 == 0, F.when(ident % 3 != 0, sha(text)), sha(new), sha(F.trim(text)), sha(F.trim(new))).alias("outcome"))


@query("g1_seed", f"""WITH q AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'dead' ELSE 'retry' END AS state, {K} AS attempts, CASE WHEN value < 50 THEN 'parse' ELSE 'gone' END AS code, CASE WHEN event_id % 4 <> 0 THEN event_type END AS sha FROM events WHERE event_id % 3 <> 0),
l AS (SELECT event_id, 5 AS priority, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE event_type END AS sha, event_id % 2 = 0 AS captured, event_id % 7 = 0 AS reopen FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0),
j AS (SELECT event_id, q.state, q.attempts, q.code, q.sha, l.priority, l.sha AS new_sha, captured, q.event_id IS NULL AS fresh, coalesce((reopen AND q.state = 'done') OR (q.state = 'dead' AND code = 'parse' AND q.sha IS NOT NULL AND l.sha <> q.sha), false) AS again FROM q FULL JOIN l USING (event_id))
SELECT event_id, CASE WHEN fresh THEN CASE WHEN captured THEN 'done' ELSE 'pending' END WHEN again THEN 'pending' ELSE state END AS state, CASE WHEN fresh OR again THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT again THEN code END AS last_error_code, coalesce(priority, 1) AS priority, coalesce(new_sha, sha) AS listing_sha FROM j""")
def seed(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    ident, kind = F.col("event_id"), F.col("event_type")
    rows = events.filter(ident % 3 != 0).select(
        "event_id", F.when(kind == "purchase", "done").when(kind == "error", "dead").otherwise("retry").alias("state"), _k().alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
        F.when(F.col("value") < 50, "parse").otherwise("gone").alias("last_error_code"), F.lit(1).alias("priority"), F.when(ident % 4 != 0, kind).alias("listing_sha"),
    )
    listed = events.filter((ident % 2 == 0) | (ident % 5 == 0)).select("event_id", F.lit(5).alias("priority"), F.when(ident % 5 == 0, "x").otherwise(kind).alias("listing_sha"), (ident % 2 == 0).alias("captured"), (ident % 7 == 0).alias("reopen_done"))
    return queue.seed(rows, listed, ["event_id"], ["parse"]).drop("next_attempt_at")


@query("g2_unchanged", f"""SELECT event_id FROM events WHERE CASE WHEN {K} % 2 = 0 THEN CASE WHEN value < 50 THEN event_type = 'view' ELSE user_id % 3 = 0 AND coalesce(CASE WHEN user_id % 2 = 0 THEN true END, true) AND event_type <> 'click' END
 ELSE event_type = 'error' AND ts > TIMESTAMP '{NOW}' - INTERVAL 5 DAY END""")
def unchanged(spark, sf_dir):
    user, kind = F.col("user_id"), F.col("event_type")
    post = {
        "has_body": _k() % 2 == 0, "listing_sha": F.when(F.col("value") < 50, kind), "title": user % 3, "category": F.when(user % 2 == 0, F.lit("c")), "count": F.when(kind == "click", 1).otherwise(0),
        "availability": F.when(kind == "error", "restricted"), "last_attempt_at": F.col("ts").cast("timestamp"),
    }
    listed = {"listing_sha": F.lit("view"), "title": F.lit(0), "category": F.lit("c"), "count": F.lit(0)}
    return _t(spark, sf_dir, "events").filter(queue.unchanged(post, listed, F.lit(NOW).cast("timestamp"), 5)).select("event_id")


@query("g7_full_requeue", f"SELECT event_id FROM events WHERE event_id <= 500 AND ts < TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 40")
def full_requeue(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter((F.col("event_id") <= 500) & (F.col("ts") < _ntz(NOW))).orderBy("ts", "event_id").limit(40).select("event_id")


@query("g9_requeue", f"""SELECT event_id, CASE WHEN value < 30 AND event_type <> 'view' THEN 'pending' WHEN event_type = 'view' THEN 'running' ELSE 'dead' END AS state, CASE WHEN value < 30 AND event_type <> 'view' THEN 0 ELSE {K} END AS attempts FROM events""")
def requeue(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_type") == "view", "running").otherwise("dead").alias("state"), _k().alias("attempts"), F.lit("e").alias("last_error_code"))
    return queue.requeue(rows, F.col("value") < 30).select("event_id", "state", "attempts")


@query("g10_revive_missing", "SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def revive_missing(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").withColumn("state", F.when(F.col("toxic") == 0, "dead").otherwise("done"))
    return queue.revive_missing(rows, _t(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"]).select("doc_id")


@query("g11_finish", f"""SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 3 = 0 AND {K} = {K} % 50 THEN 'done' WHEN event_type = 'view' THEN 'running' ELSE 'pending' END AS state, event_id % 3 = 0 AND NOT (event_type = 'view' AND {K} = {K} % 50) AS fenced FROM events""")
def finish(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    rows = events.select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("pending").alias("state"), _k().cast("string").alias("lease_token"))
    reports = events.filter("event_id % 3 = 0").select("event_id", (_k() % 50).cast("string").alias("lease_token"), F.lit("done").alias("state"))
    return queue.finish(rows, reports, ["event_id"]).select("event_id", "state", "fenced")


@query("g16_stale_runs", f"""WITH r AS (SELECT user_id, min(ts) AS started_at, CASE WHEN count(*) % 2 = 0 THEN 'running' ELSE 'done' END AS state FROM events GROUP BY 1)
SELECT user_id FROM r WHERE state = 'running' AND started_at < TIMESTAMP '2024-01-29' AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29')""")
def stale_runs(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    runs = events.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.when(F.count("*") % 2 == 0, "running").otherwise("done").alias("state"))
    return queue.stale_runs(runs, events, "user_id", "ts", _ntz("2024-01-29")).select("user_id")


@query("g21_fill_window", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT greatest(0, 10000 - (SELECT count(*) FROM labels WHERE quality = 1))")
def fill_window(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").withColumn("state", F.when(F.col("quality") == 1, "pending").otherwise("done"))
    return queue.fill_window(rows, _t(spark, sf_dir, "documents"), ["doc_id"], 10_000, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id")


@query("g6_reserved_batch", """(SELECT event_id, 'due' AS kind FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 19) UNION ALL (SELECT event_id, 'revisit' FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 1)""")
def reserved_batch(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return queue.reserved_batch(events.filter("event_type = 'error'"), events.filter("event_type = 'purchase'"), 20, [F.col("event_id")], [F.col("ts"), F.col("event_id")]).select("event_id", "kind")


@query("g22_failures", f"""SELECT event_id, CASE event_type WHEN 'signup' THEN 'review' WHEN 'click' THEN 'conflict' WHEN 'error' THEN 'gone' ELSE 'retry' END AS kind, ([60, 300, 1800, 7200])[greatest(1, least({K}, 4))] AS delay FROM events""")
def failures(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", queue.failure_kind(F.col("event_type"), ["signup"], ["click"], ["error"]).alias("kind"), queue.import_delay(_k()).alias("delay"))


@query("g23_next_threads", "SELECT conv_id FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) WHERE conv_id % 2 = 0 AND conv_id % 6 <> 0 ORDER BY m DESC, conv_id LIMIT 10")
def next_threads(spark, sf_dir):
    threads = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.max("turn").alias("updated_at"))
    threads = threads.withColumns({"status": F.when(F.col("thread_id") % 2 == 0, "active").otherwise("gone"), "retry_at": F.when(F.col("thread_id") % 6 == 0, 100)})
    return queue.next_thread(threads, F.lit(5), 10).select(F.col("thread_id").alias("conv_id"))


@query("g24_sweep_stop", """SELECT user_id, min(CASE WHEN value < 10 THEN event_id END) AS stop_page FROM events GROUP BY 1""")
def sweep_stop(spark, sf_dir):
    return queue.sweep_stop(_t(spark, sf_dir, "events").withColumn("before", F.lit(10.0)), "user_id", "event_id", "value", "before")


_GROUPS = """g AS (SELECT c_nationkey AS board, o_custkey % 10 AS grp, o_orderkey AS post, o_orderdate AS d, CASE WHEN o_orderkey % 50 <> 0 THEN 'a' END AS author, 'w' || (o_custkey % 10) AS title, o_orderkey % 40 <> 0 AS available FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 < 2 AND c_nationkey < 12),
e AS (SELECT 'c' || board || '-' || (CASE WHEN post % 11 = 0 THEN grp + 1 ELSE grp END) AS collection, post, post AS position FROM g WHERE grp < 5 AND post < 1200),
le AS (SELECT collection, arg_max(post, position) AS last_entry FROM e GROUP BY 1), j AS (SELECT g.*, e.collection FROM g LEFT JOIN e USING (post)),
f AS (SELECT board, grp, bool_or(coalesce(trim(author), '') = '') AS unknown, bool_and(available) AS av, count(DISTINCT collection) AS cs, count(collection) AS ms, min(collection) AS collection, arg_max(post, (post)) FILTER (collection IS NOT NULL) AS anchor, min(title) AS title FROM j GROUP BY 1, 2),
v AS (SELECT f.board, f.grp, CASE WHEN unknown THEN 'unknown_author' WHEN cs = 0 AND (f.board % 4 = 0 AND f.grp = 7 OR NOT av) THEN 'new_collection_conflict' WHEN cs = 0 THEN 'new_collection' WHEN cs <> 1 OR ms < 2 THEN 'ambiguous_or_unanchored' WHEN last_entry IS DISTINCT FROM anchor THEN 'last_entry_not_anchor' ELSE 'append' END AS verdict, f.collection, anchor FROM f LEFT JOIN le USING (collection))"""


def _reconciled(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").filter("o_orderkey % 7 < 2").join(_t(spark, sf_dir, "customer").filter("c_nationkey < 12"), F.col("o_custkey") == F.col("c_custkey"))
    post, grp = F.col("o_orderkey"), F.col("o_custkey") % 10
    groups = rows.select(F.col("c_nationkey").alias("board"), grp.alias("grp"), post.alias("post"), post.alias("ord"), F.when(post % 50 != 0, "a").alias("author"), F.concat(F.lit("w"), grp).alias("title"), (post % 40 != 0).alias("available"))
    to = F.when(F.col("post") % 11 == 0, F.col("grp") + 1).otherwise(F.col("grp"))
    entries = groups.filter("grp < 5 AND post < 1200").select(F.concat(F.lit("c"), "board", F.lit("-"), to).alias("collection"), "post", F.col("post").alias("position"))
    titles = groups.filter("board % 4 = 0 AND grp = 7").select("board", "title")
    return works.reconcile(groups, entries, "board", "grp", "post", "ord", titles)


@query("e2_reconcile", f"WITH {_GROUPS} SELECT board, grp, verdict, CASE WHEN verdict = 'append' THEN collection END AS collection FROM v")
def reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)[0]


@query("e2_appended", f"WITH {_GROUPS} SELECT v.collection, j.post FROM j JOIN v USING (board, grp) WHERE verdict = 'append' AND j.collection IS NULL AND available AND j.post > anchor")
def appended(spark, sf_dir):
    return _reconciled(spark, sf_dir)[1].select("collection", "post")


@query("e3_skip_reasons", f"WITH {_GROUPS} SELECT verdict, count(*) AS n FROM v WHERE verdict NOT IN ('append', 'new_collection') GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return _reconciled(spark, sf_dir)[0].filter(~F.col("verdict").isin("append", "new_collection")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("e8_aliases", """SELECT n AS alias, n - n % 10 + 9 AS canonical FROM range(200) t(n) WHERE n % 10 <> 9""")
def alias_chains(spark, sf_dir):
    """Works are renamed in chains of ten, each name to the next."""
    names = spark.range(200).filter("id % 10 <> 9").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"), F.lit(1).alias("at"))
    return works.aliases(names, "old", "new", "at")


@query("e13_thread_works", """WITH t AS (SELECT conv_id, min(role) AS k, max(turn) AS upd FROM conversations GROUP BY 1), f AS (SELECT k, arg_max('title ' || conv_id, (upd, conv_id)) AS work_title, count(DISTINCT conv_id) AS threads FROM t GROUP BY 1)
SELECT c.conv_id, c.turn, work_title, threads, row_number() OVER (PARTITION BY k ORDER BY upd, c.conv_id, c.turn)::INT AS place FROM conversations c JOIN t USING (conv_id) JOIN f USING (k)""")
def thread_works(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    threads = turns.groupBy("conv_id").agg(F.min("role").alias("k"), F.max("turn").alias("updated")).withColumn("title", F.concat(F.lit("title "), "conv_id"))
    return works.thread_works(threads, turns.select("conv_id", "turn"), "k", "conv_id", "updated", "turn").select("conv_id", "turn", "work_title", "threads", "place")


@query("e14_pinned", "SELECT doc_id, coalesce(CASE WHEN doc_id % 9 = 0 THEN 'pinned' END, lang) AS k FROM documents")
def pinned(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", works.pinned_key(F.col("lang"), F.when(F.col("doc_id") % 9 == 0, "pinned")).alias("k"))


@query("e15_same_chapters", """WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, count(*) AS m FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2)
SELECT l_orderkey, bool_and(n IS NOT DISTINCT FROM m) AS equal, count(*) FILTER (n = 1 AND m = 1) AS shared FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1 HAVING count(n) > 0 AND count(m) > 0""")
def same_chapters(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return works.same_chapters(lines.filter("l_returnflag <> 'R'"), lines.filter("l_quantity > 5"), "l_orderkey", "l_linenumber")


@query("e16_chapter_aliases", "SELECT DISTINCT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])), ',') AS aliases FROM orders")
def chapter_aliases(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"))), ",").alias("aliases")).distinct()


@query("e17_recovery_plan", """WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 20 END AS v FROM events), p AS (SELECT user_id, event_id, event_id % 25 AS v FROM events WHERE event_id % 2 = 0),
q AS (SELECT *, count(*) OVER (PARTITION BY user_id, v) AS n FROM p) SELECT c.user_id, c.event_id, CASE WHEN n = 1 AND c.v IS NULL THEN q.v ELSE c.v END AS value, CASE WHEN n > 1 THEN 'conflict' WHEN c.v IS NULL THEN 'filled' WHEN c.v = q.v THEN 'same' ELSE 'kept' END AS outcome FROM c JOIN q USING (user_id, event_id)""")
def recovery_plan(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id")
    chapters = events.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 20))
    return works.recovery_plan(chapters, events.filter("event_id % 2 = 0").withColumn("v", F.col("event_id") % 25), "user_id", "event_id", "v")


@query("e20_record_works", """WITH r AS (SELECT DISTINCT lang || '/' || source || '/' || (doc_id % 5) AS path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), w AS (SELECT DISTINCT lang AS work FROM documents WHERE lang <> 'de' UNION SELECT lang || '/' || source FROM documents WHERE source IN ('src1', 'src2'))
SELECT path, (SELECT arg_max(work, length(work)) FROM w WHERE path = work OR starts_with(path, work || '/')) AS work FROM r""")
def record_works(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    records = docs.select(F.concat_ws("/", "lang", "source", (F.col("doc_id") % 5).cast("string")).alias("path")).distinct()
    known = docs.filter("lang <> 'de'").select(F.col("lang").alias("work")).union(docs.filter("source IN ('src1', 'src2')").select(F.concat_ws("/", "lang", "source").alias("work")))
    return works.record_work(records, known, "path", "work")


@query("h1_post_documents", """SELECT conv_id, 'posts/' || conv_id || '-' || sha256(p) || '.json' AS object_key FROM (SELECT conv_id, '{"last":' || max(turn) || ',"comments":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' || chr(10) AS p FROM conversations GROUP BY 1)""")
def post_documents(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    posts = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return release.post_documents(posts, turns, "conv_id", "turn", ["last"], ["role"]).select("conv_id", "object_key")


@query("h4_release_tables", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def release_tables(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", tx.content_hash(F.col("text")).alias("sha"))
    return release.release_tables(docs, "source", "doc_id", "sha").select("source", "n")


@query("h10_validate", """WITH s AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM documents WHERE source IS NOT NULL), e AS (SELECT l_orderkey AS collection, l_partkey AS post, l_linenumber AS position FROM lineitem),
f AS (SELECT collection, count(*) n, min(position) l, max(position) h, count(DISTINCT position) d FROM e GROUP BY 1)
SELECT 'search_is_boards' AS check_name, (SELECT count(*) FROM (FROM s EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM s)) AS faults UNION ALL SELECT 'one_collection', (SELECT count(*) FROM (SELECT post FROM e GROUP BY 1 HAVING count(DISTINCT collection) > 1))
UNION ALL SELECT 'contiguous', (SELECT count(*) FROM f WHERE l <> 1 OR h <> n OR d <> n) UNION ALL SELECT 'totals', (SELECT count(*) FROM f FULL JOIN (SELECT o_orderkey AS collection, 3 AS m FROM orders) USING (collection) WHERE coalesce(n, 0) <> coalesce(m, 0))""")
def validate(spark, sf_dir):
    """A release that is wrong in most ways: the faults are counted."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), "source")
    entries = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("collection"), F.col("l_partkey").alias("post"), F.col("l_linenumber").alias("position"))
    totals = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("collection"), F.lit(3).alias("n"))
    return release.validate(docs, docs.filter("source IS NOT NULL"), entries, totals, "post").withColumnRenamed("check", "check_name")


@query("h13_retained", "SELECT user_id FROM (SELECT user_id, max(ts) AS last_at, row_number() OVER (ORDER BY max(ts) DESC) AS r FROM events GROUP BY 1) WHERE user_id = 3 OR r <= 5 OR last_at > TIMESTAMP '2024-01-30'")
def retained(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return release.retained(runs, F.col("user_id") == 3, "last_at", 5, _ntz("2024-01-30")).select("user_id")


@query("h17_receipts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 + doc_id % 2 * 2 END AS revision FROM documents")
def receipts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 2 * 2).alias("revision"))
    return release.finalise_receipts(rows, _t(spark, sf_dir, "labels"), "doc_id")


@query("j1_activity_spans", """WITH b AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), n AS (SELECT *, CASE WHEN t <= lag(t) OVER (PARTITION BY user_id ORDER BY t) + 3600 THEN 0 ELSE 1 END AS new FROM b), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS span FROM n)
SELECT user_id, min(t) AS start, max(t) + 3600 AS stop FROM s GROUP BY user_id, span""")
def activity_spans(spark, sf_dir):
    beats = _t(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return reading.activity_spans(beats, ["user_id"], "t", 3600).select("user_id", "start", "stop")


@query("j2_clipped_days", """WITH b AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events) SELECT user_id, sum(greatest(0, least(t + 3600, epoch(TIMESTAMP '2024-01-15 00:20:00')::BIGINT) - t))::BIGINT AS seconds FROM b GROUP BY 1""")
def clipped_days(spark, sf_dir):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    now = F.unix_timestamp(F.lit("2024-01-15 00:20:00").cast("timestamp"))
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), reading.clipped(t + 3600, now) - t)).alias("seconds"))


@query("j4_local_days", """WITH s AS (SELECT user_id, (ts + INTERVAL 9 HOUR)::DATE AS day, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 1800 AS b FROM events), o AS (SELECT *, max(b) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM o), u AS (SELECT user_id, day, max(b) - min(a) AS n FROM n GROUP BY user_id, day, i) SELECT user_id, day, sum(n)::BIGINT AS seconds FROM u GROUP BY 1, 2""")
def local_days(spark, sf_dir):
    """Time per day of the reader's zone; a session counts for the day on which it began."""
    at = F.col("ts").cast("timestamp")
    start = F.unix_timestamp(at)
    spans = _t(spark, sf_dir, "events").select("user_id", F.to_date(F.from_utc_timestamp(at, "Asia/Seoul")).alias("day"), start.alias("a"), (start + 1800).alias("b"))
    return reading.interval_union(spans, ["user_id", "day"], "a", "b").groupBy("user_id", "day").agg(F.sum(F.col("b") - F.col("a")).alias("seconds"))


@query("j7_month_cells", """SELECT ((day(d) - 1 + 0) // 7)::INT AS week, (isodow(d) - 1)::INT AS weekday, d AS day, coalesce(n, 0) AS value FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN (SELECT ts::DATE AS e, count(*) AS n FROM events GROUP BY 1) ON d = e""")
def month_cells(spark, sf_dir):
    days = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return reading.month_cells(days, "d", "n", F.lit("2024-01-10").cast("date"))


@query("j10_collection_progress", """WITH h AS (SELECT l_partkey AS post, max(l_discount * 10) AS p FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), m AS (SELECT p_partkey AS post, p_brand AS collection, p_size > 5 AS available FROM part),
c AS (SELECT collection, count(*) FILTER (p >= 0.95) AS finished, count(*) FILTER (p > 0 AND p < 0.95) AS reading, count(*) FILTER (available) AS available FROM m LEFT JOIN h USING (post) GROUP BY 1)
SELECT *, CASE WHEN available = 0 THEN 'empty' WHEN finished >= available THEN 'finished' WHEN finished + reading > 0 THEN 'reading' ELSE 'unread' END AS occupancy FROM c""")
def collection_progress(spark, sf_dir):
    history = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("post"), (F.col("l_discount") * 10).alias("progress"))
    members = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("post"), F.col("p_brand").alias("collection"), (F.col("p_size") > 5).alias("available"))
    return reading.collection_progress(history, members, "collection", "post", "progress")


def _work_progress(spark, sf_dir):
    history = _t(spark, sf_dir, "events").select(F.col("user_id").alias("work"), (F.col("value") / 100).alias("progress"), F.col("ts").alias("read_at"), F.when(F.col("event_type") == "view", _k()).alias("total"))
    chapters = history.select("work").distinct().withColumn("chapter_count", F.lit(98).cast("long"))
    return reading.work_progress(history, "work", "progress", "read_at", "total", chapters)


_WORKS = f"w AS (SELECT user_id AS work, count(*) FILTER (value / 100 >= 0.95) AS finished, count(*) FILTER (value / 100 > 0 AND value / 100 < 0.95) AS reading, max(ts) AS last_read, coalesce(max({K}) FILTER (event_type = 'view'), 0) AS seen_total FROM events GROUP BY 1), p AS (SELECT *, CASE WHEN seen_total > 0 THEN greatest(98 - seen_total, 0) ELSE 0 END AS fresh FROM w)"


@query("j13_work_progress", f"WITH {_WORKS} SELECT * FROM p")
def work_progress(spark, sf_dir):
    return _work_progress(spark, sf_dir)


@query("j22_home_works", f"WITH {_WORKS} SELECT work FROM p WHERE reading > 0 OR fresh > 0 ORDER BY fresh > 0 DESC, last_read DESC, work LIMIT 8")
def home_works(spark, sf_dir):
    return reading.home_works(_work_progress(spark, sf_dir)).select("work")


@query("j17_bin_summary", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def bin_summary(spark, sf_dir):
    return reading.bin_summary(_t(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click"])


@query("j18_episode_states", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' WHEN value / 100 >= 0.95 THEN 'read' WHEN value > 20 THEN 'reading' WHEN user_id % 2 = 0 THEN 'new' ELSE 'unread' END AS state FROM events")
def episode_states(spark, sf_dir):
    progress = F.when(F.col("value") > 20, F.col("value") / 100).otherwise(0)
    return _t(spark, sf_dir, "events").select("event_id", reading.episode_state(progress, F.col("event_type") != "error", F.col("user_id") % 2 == 0).alias("state"))


@query("j21_trim", "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000")
def trim(spark, sf_dir):
    return reading.trim_to_budget(_t(spark, sf_dir, "documents"), ["source"], "doc_id", "doc_id", "n_chars", 20_000).select("doc_id")


@query("k4_differences", "SELECT doc_id, 'put' AS change FROM documents WHERE doc_id % 10 > 6 AND doc_id % 10 <> 9 UNION ALL SELECT doc_id, 'delete' FROM documents WHERE doc_id % 10 = 9")
def differences(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    local = docs.filter("doc_id % 10 <> 9").withColumn("lang", F.when(F.col("doc_id") % 10 > 6, "changed").otherwise(F.col("lang")))
    return sync.differences(local, docs, "doc_id", "lang")


@query("k5_settle", """WITH l AS (SELECT user_id AS k, max(ts) AS at FROM events WHERE event_type <> 'click' GROUP BY 1), p AS (SELECT user_id AS k, max(ts) AS at FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT k, greatest(l.at, p.at) AS at_time, CASE WHEN p.at IS NOT NULL AND (l.at IS NULL OR p.at >= l.at) THEN 'pulled' ELSE 'local' END AS origin FROM l FULL JOIN p USING (k)""")
def settle(spark, sf_dir):
    def side(kind, origin):
        return _t(spark, sf_dir, "events").filter(F.col("event_type") != kind).groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("at_time")).withColumn("origin", F.lit(origin))

    return sync.settle(side("click", "local"), side("view", "pulled"), "k", "at_time")


@query("k6_merge_history", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def merge_history(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return sync.merge_history(rows, "user_id", "ts", "value", "event_id").select("user_id", "event_id", "value")


@query("k7_merge_annotations", """WITH a AS (SELECT user_id, bool_or(event_type = 'error' AND value > 90) AS deleted, arg_max(event_type, (ts, event_id)) AS t, list_sort(list(DISTINCT event_type)) AS everything FROM events GROUP BY 1)
SELECT user_id, deleted, CASE WHEN NOT deleted THEN t END AS text, CASE WHEN deleted THEN '' ELSE array_to_string(list_filter(everything, lambda x: x <> t), ',') END AS conflicts FROM a""")
def merge_annotations(spark, sf_dir):
    notes = _t(spark, sf_dir, "events").withColumn("gone", (F.col("event_type") == "error") & (F.col("value") > 90))
    return sync.merge_annotations(notes, "user_id", "ts", "gone", "event_type", "event_id").withColumn("conflicts", F.array_join("conflicts", ","))


@query("k8_merge_sessions", "SELECT user_id, min(ts) AS start, max(ts) AS stop FROM events GROUP BY 1")
def merge_sessions(spark, sf_dir):
    return sync.merge_sessions(_t(spark, sf_dir, "events").select("user_id", F.col("ts").alias("start"), F.col("ts").alias("stop")), "user_id", "start", "stop")


@query("k9_merge_shelves", "WITH s AS (SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE ' ' || p_brand END)) AS n FROM part) SELECT p_partkey, min(p_partkey) OVER (PARTITION BY n) AS canonical FROM s")
def merge_shelves(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand"))
    return sync.merge_shelves(_t(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.lit(0).alias("made")), "p_partkey", "name", "made")


@query("k10_rekey", "SELECT CASE WHEN user_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def rekey(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    names = events.filter("user_id % 3 = 0").select(F.col("user_id").alias("alias"), (F.col("user_id") + 1).alias("canonical")).distinct()
    return sync.rekey(events, names, "user_id", "ts", "event_id").select("user_id", "event_id")


@query("k11_sanitise", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value > 10) WHERE n <= 3")
def sanitise(spark, sf_dir):
    return sync.sanitise(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") > 10, 3).select("user_id", "event_id")


@query("k12_prune", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def prune(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sync.prune_operations(events, "ts", F.lit("2024-02-24").cast("timestamp")).select("event_id")
