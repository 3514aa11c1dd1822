"""Queries about runs, boards and passes, each with its SQL. Users stand for boards or runs, events for captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.operators import coverage, relational


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Boards made of events: time of the last pass (null where there is none), next page, anchor.
BOARDS = """boards AS (SELECT user_id AS board, max(ts) FILTER (event_type = 'purchase' AND json_extract_string(props, '$.k')::BIGINT > 60) AS last_at,
  1 + count(*) FILTER (event_type = 'error') % 3 AS next_page, min(event_id) AS anchor FROM events GROUP BY 1)"""
SINCE = "2024-01-25"


def _boards(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    passed = (F.col("event_type") == "purchase") & (F.get_json_object("props", "$.k").cast("long") > 60)
    return events.groupBy(F.col("user_id").alias("board")).agg(F.max(F.when(passed, F.col("ts"))).alias("last_at"), (1 + F.count_if(F.col("event_type") == "error") % 3).alias("next_page"), F.min("event_id").alias("anchor"))


def _since():
    return F.lit(SINCE).cast("timestamp_ntz")


@query("a9_resume_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def resume_scan(spark, sf_dir):
    return coverage.resume_scan(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, 100)


@query("a10_spaced_sample", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE p IN (SELECT round_even(i * (n - 1) / 16.0, 0) FROM range(17) t(i))""")
def spaced_sample(spark, sf_dir):
    return coverage.spaced_sample(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 17)


@query("b3_run_outcomes", "SELECT event_type AS outcome, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def run_outcomes(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter("user_id = 7").groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query("b4_latest_codes", """WITH r AS (SELECT user_id, event_type AS url, CASE WHEN value < 20 THEN json_extract_string(props, '$.k') END AS code,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) SELECT DISTINCT user_id, code FROM r WHERE n = 1 AND code IS NOT NULL""")
def latest_codes(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("code", F.when(F.col("value") < 20, F.get_json_object("props", "$.k")))
    return coverage.latest_codes(events, "user_id", "event_type", "event_id", "code")


@query("b5_run_status", """WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'signup') AS outcomes, count(*) AS scheduled, count(*) FILTER (event_type = 'error' AND value > 90) AS failed,
  list(DISTINCT event_type) FILTER (event_type IN ('error', 'click') AND value > 95) AS codes FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(list_filter(coalesce(codes, []), lambda x: x <> 'click')) = 0 AND outcomes = scheduled AND failed = 0 THEN 'succeeded' WHEN outcomes > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""")
def run_status(spark, sf_dir):
    code = F.when(F.col("event_type").isin("error", "click") & (F.col("value") > 95), F.col("event_type"))
    runs = _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "signup").alias("outcomes"), F.count("*").alias("scheduled"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 90)).alias("failed"), F.collect_set(code).alias("codes")
    )
    return runs.select("user_id", coverage.run_status(F.col("outcomes"), F.col("scheduled"), F.col("failed"), F.col("codes"), ["click"]).alias("status"))


@query("b9_pass_coverage", f"""WITH {BOARDS}, c AS (SELECT count(*) AS total, count(*) FILTER (last_at >= '{SINCE}' AND next_page = 1) AS completed, count(*) FILTER (next_page > 1) AS in_progress, sum(next_page)::BIGINT AS pages FROM boards)
SELECT total, completed, in_progress, greatest(total - completed - in_progress, 0) AS pending, total > 0 AND completed = total AS complete, pages FROM c""")
def pass_coverage(spark, sf_dir):
    return coverage.pass_coverage(_boards(spark, sf_dir), _since())


@query("b10_incomplete_boards", f"WITH {BOARDS} SELECT board FROM boards WHERE NOT coalesce(last_at >= '{SINCE}' AND next_page = 1, false)")
def incomplete_boards(spark, sf_dir):
    boards = _boards(spark, sf_dir)
    return boards.filter(~coverage.covered(boards, _since())).select("board")


@query("b11_progress_signature", f"WITH {BOARDS} SELECT sum(next_page)::BIGINT AS pages, count(*) FILTER (last_at >= '{SINCE}' AND next_page = 1) AS completed FROM boards")
def progress_signature(spark, sf_dir):
    return coverage.pass_coverage(_boards(spark, sf_dir), _since()).select("pages", "completed")


@query("b12_pending_without_body", "SELECT count(*) > 0 AS pending FROM labels l LEFT JOIN documents d USING (doc_id) WHERE coalesce(d.text, '') = ''")
def pending_without_body(spark, sf_dir):
    bodies = _t(spark, sf_dir, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id")
    first = _t(spark, sf_dir, "labels").join(bodies, "doc_id", "left_anti").limit(1)
    return first.agg((F.count("*") > 0).alias("pending"))


@query("b13_outline_only", """SELECT source, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source = s.source AND l.doc_id IS NULL) AS outline_only FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s""")
def outline_only(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "source")
    labels = _t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("known").isNull()).alias("outline_only"))


@query("b14_move_anchors", f"WITH {BOARDS}, s AS (SELECT user_id AS board, max(event_id) AS most FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1) SELECT board, coalesce(most, anchor) AS anchor FROM boards LEFT JOIN s USING (board)")
def move_anchors(spark, sf_dir):
    seen = _t(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 60").select(F.col("user_id").alias("board"), "event_id")
    return coverage.move_anchors(_boards(spark, sf_dir).select("board", "anchor"), seen, "board", "anchor", "event_id")


@query("b15_board_order", f"""WITH {BOARDS} SELECT board, row_number() OVER (ORDER BY CASE WHEN next_page > 1 THEN 0 ELSE 1 END, CASE WHEN next_page > 1 THEN last_at END DESC NULLS LAST,
  CASE WHEN next_page = 1 THEN last_at END ASC NULLS FIRST, board) AS place FROM boards ORDER BY place LIMIT 30""")
def board_order(spark, sf_dir):
    order = coverage.board_order("last_at", "next_page", "board")
    return relational.numbered(_boards(spark, sf_dir).orderBy(*order).limit(30), *order).select("board", "place")


@query("b18_collection_summary", """SELECT c_custkey, c_name, count(o_orderkey) AS entries, count(l_orderkey) AS lines, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey
LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY c_custkey, c_name""")
def collection_summary(spark, sf_dir):
    first = _t(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("entries"), F.count("l_orderkey").alias("lines"), F.max("o_orderdate").alias("last_at"))
    return _t(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("lines", F.lit(0)).alias("lines"), "last_at")


@query("b19_collection_popularity", """SELECT o_custkey, coalesce(sum(n), 0)::BIGINT AS views, count(*) FILTER (n IS NULL) AS unavailable FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def collection_popularity(spark, sf_dir):
    seen = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_custkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("views"), F.count_if(F.col("n").isNull()).alias("unavailable"))


@query("b20_membership", """SELECT c_nationkey, c_custkey, coalesce(o_orderkey, -c_custkey) AS member, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(o_orderkey, -c_custkey), c_custkey) AS place FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def membership(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = _t(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", "c_custkey", F.coalesce("o_orderkey", -F.col("c_custkey")).alias("member"))
    return relational.numbered(rows, F.col("member"), F.col("c_custkey"), keys=["c_nationkey"]).select("c_nationkey", "c_custkey", "member", F.col("place").cast("long").alias("place"))


@query("b23_lane_totals", """SELECT lang, count(*) AS items, sum(n_chars)::BIGINT AS chars, count(p.k) AS published FROM documents d LEFT JOIN (SELECT 'doc/' || doc_id AS k, quality FROM labels WHERE quality = 1) p ON 'doc/' || d.doc_id = p.k GROUP BY 1""")
def lane_totals(spark, sf_dir):
    done = _t(spark, sf_dir, "labels").filter("quality = 1").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("k"))
    rows = _t(spark, sf_dir, "documents").select("lang", "n_chars", F.concat(F.lit("doc/"), F.col("doc_id")).alias("k")).join(done.withColumn("hit", F.lit(1)), "k", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("items"), F.sum("n_chars").alias("chars"), F.count("hit").alias("published"))


@query("b24_batches", """SELECT count(*) FILTER (l_linenumber = 1) AS first_revision, count(*) FILTER (l_linenumber = 2) AS second_revision, min(l_shipdate) FILTER (l_linestatus = 'O' AND l_linenumber = 1) AS oldest_unpublished FROM lineitem""")
def batches(spark, sf_dir):
    n = F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").agg(F.count_if(n == 1).alias("first_revision"), F.count_if(n == 2).alias("second_revision"), F.min(F.when((F.col("l_linestatus") == "O") & (n == 1), F.col("l_shipdate"))).alias("oldest_unpublished"))


@query("b26_latest_event_per_run", """WITH e AS (SELECT l_orderkey, l_partkey * 100000 + l_suppkey AS sequence, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, o_orderstatus, sequence AS event_sequence, l_returnflag AS event_l_returnflag FROM orders o LEFT JOIN e ON e.l_orderkey = o.o_orderkey AND e.sequence =
 (SELECT max(x.sequence) FROM e x WHERE x.l_orderkey = o.o_orderkey AND (o.o_orderstatus = 'O' OR x.l_returnflag <> 'N'))""")
def latest_event_per_run(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    events = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("sequence"), "l_returnflag")
    events = events.groupBy("o_orderkey", "sequence").agg(F.max("l_returnflag").alias("l_returnflag"))
    return coverage.latest_event(runs, events, "o_orderkey", "sequence", ["l_returnflag"], (F.col("o_orderstatus") == "O") | (F.col("l_returnflag") != "N"))


@query("b28_latest_of_kind", """SELECT event_type, arg_max(event_id, (ts, event_id)) AS latest, max(ts) AS latest_at FROM events GROUP BY 1""")
def latest_of_kind(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("latest_at"))


@query("b30_runs_page", "SELECT event_id, value, true AS has_more FROM events WHERE value < 50 OR (value = 50 AND event_id < 100) ORDER BY value DESC, event_id DESC LIMIT 20")
def runs_page(spark, sf_dir):
    return coverage.keyset_page(_t(spark, sf_dir, "events").select("event_id", "value"), [("value", True), ("event_id", True)], 20, (50.0, 100))


@query("b31_json_parameters", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT unnest([3, 5, 8])) AND user_id BETWEEN 2 AND 40 GROUP BY 1")
def json_parameters(spark, sf_dir):
    """Identities come as a JSON array; those in its range that it doesn't name are counted."""
    given = spark.range(1).select(F.explode(F.from_json(F.lit('[{"id":3},{"id":5},{"id":8}]'), "array<struct<id:long>>")).alias("x")).select(F.col("x.id").alias("user_id"))
    return _t(spark, sf_dir, "events").filter("user_id BETWEEN 2 AND 40").join(given, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("b32_json_path", "SELECT event_id, coalesce(json_extract_string(props, '$.code'), json_extract_string(props, '$.k')) AS code FROM events WHERE coalesce(json_extract_string(props, '$.code'), json_extract_string(props, '$.k')) = '7'")
def json_path(spark, sf_dir):
    code = F.coalesce(F.get_json_object("props", "$.code"), F.get_json_object("props", "$.k"))
    return _t(spark, sf_dir, "events").select("event_id", code.alias("code")).filter("code = '7'")


@query("b34_candidate_listing", """SELECT l_orderkey, l_linenumber, p_name, s_name, CASE WHEN r_name IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey WHERE l_quantity > 45""")
def candidate_listing(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    region = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_t(spark, sf_dir, "supplier").filter("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(region, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    state = F.when(F.col("r_name").isNull(), "unknown").when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name", state.alias("state"))


_VERIFIED = """items AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), p AS (SELECT 'published/' || doc_id AS k, sha256(coalesce(text, '')) AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
good AS (SELECT doc_id, sha, 'current' AS copy FROM items JOIN p ON 'published/' || doc_id = k AND sha = s)"""


def _verified(spark, sf_dir):
    items = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    labels = _t(spark, sf_dir, "labels")
    published = items.join(labels.filter("quality = 1").select("doc_id"), "doc_id").select(F.concat(F.lit("published/"), F.col("doc_id")).alias("object_key"), F.col("sha").alias("object_sha"))
    return coverage.verified_view(items, published, items.join(labels.select("doc_id"), "doc_id"), "doc_id", "sha")


@query("b35_verified_view", f"WITH {_VERIFIED} SELECT * FROM good")
def verified_view(spark, sf_dir):
    return _verified(spark, sf_dir).filter("copy = 'current'")


@query("b36_verified_or_last", f"WITH {_VERIFIED} SELECT * FROM good UNION ALL SELECT i.doc_id, i.sha, 'last_verified' FROM items i JOIN labels USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = i.doc_id)")
def verified_or_last(spark, sf_dir):
    return _verified(spark, sf_dir)


@query("b38_upload_plan", """SELECT l_partkey, coalesce(attempt, 0) AS attempt, min(l_shipdate) AS l_shipdate FROM lineitem LEFT JOIN (SELECT p_partkey, p_size AS attempt FROM part WHERE p_size < 10) ON l_partkey = p_partkey GROUP BY l_partkey, attempt ORDER BY 2, 3, 1 LIMIT 50""")
def upload_plan(spark, sf_dir):
    tried = _t(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("attempt"))
    return coverage.upload_plan(_t(spark, sf_dir, "lineitem"), tried, "l_partkey", "l_shipdate").orderBy("attempt", "l_shipdate", "l_partkey").limit(50)


@query("b39_chapter_facts", """SELECT l.l_orderkey, l.l_linenumber, m.l_quantity AS matched FROM lineitem l LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber AND l.l_partkey = m.l_partkey""")
def chapter_facts(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = _t(spark, sf_dir, "lineitem")
    facts = lines.filter("l_returnflag = 'R'").select(*keys, F.col("l_quantity").alias("matched"))
    return lines.select(*keys).join(facts, keys, "left").select("l_orderkey", "l_linenumber", "matched")


@query("b40_documents_by_folder", "SELECT source AS folder, doc_id, quality FROM documents JOIN labels USING (doc_id) ORDER BY folder NULLS FIRST, doc_id LIMIT 100")
def documents_by_folder(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder")).join(_t(spark, sf_dir, "labels"), "doc_id")
    return rows.orderBy(F.col("folder").asc_nulls_first(), "doc_id").limit(100).select("folder", "doc_id", "quality")


@query("b41_cast_join", "SELECT event_id, user_id, c_name FROM events JOIN customer ON TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = c_custkey")
def cast_join(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return events.join(_t(spark, sf_dir, "customer"), F.col("k") == F.col("c_custkey")).select("event_id", "user_id", "c_name")


@query("b42_changed_failures", """WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN toxic END AS code FROM labels), n AS (SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN toxic END AS code FROM labels)
SELECT doc_id FROM o JOIN n USING (doc_id) WHERE o.code IS DISTINCT FROM n.code""")
def changed_failures(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    old = labels.select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).alias("old_code"))
    new = labels.select("doc_id", F.when((F.col("quality") == 1) | (F.col("toxic") == 1), F.col("toxic")).alias("new_code"))
    return old.join(new, "doc_id").filter(~F.col("old_code").eqNullSafe(F.col("new_code"))).select("doc_id")


@query("b43_latest_validators", "SELECT o_orderkey, arg_max(l_shipdate, (l_linenumber, l_shipdate)) AS validator FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' GROUP BY 1")
def latest_validators(spark, sf_dir):
    stored = _t(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    return _t(spark, sf_dir, "orders").join(stored, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.max_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("validator"))


@query("b44_archive_reference", "SELECT sha256(text) AS sha, source, max(doc_id) AS latest FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def archive_reference(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("sha"), "source", "doc_id")
    return docs.groupBy("sha", "source").agg(F.max("doc_id").alias("latest"))


@query("b45_flag_repair", """SELECT source, count(*) FILTER (NOT flag AND starts_with(source, 'src1')) AS to_drawn, count(*) FILTER (flag AND NOT starts_with(source, 'src1')) AS to_prose
FROM (SELECT source, doc_id % 3 = 0 AS flag FROM documents) GROUP BY 1 HAVING to_drawn > 0 OR to_prose > 0""")
def flag_repair(spark, sf_dir):
    drawn, flag = F.coalesce(F.startswith(F.col("source"), F.lit("src1")), F.lit(False)), F.col("doc_id") % 3 == 0
    known = F.col("source").isNotNull()
    counts = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(known & ~flag & drawn).alias("to_drawn"), F.count_if(known & flag & ~drawn).alias("to_prose"))
    return counts.filter("to_drawn > 0 OR to_prose > 0")


@query("b46_current_captures", """SELECT o_orderdate::DATE AS file, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def current_captures(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.groupBy(F.to_date("o_orderdate").alias("file")).agg(F.count("*").alias("n"), F.min(ident).alias("first"), F.max(ident).alias("last"))


@query("b47_expired_leases", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 15 MINUTE <= TIMESTAMP '2024-01-03'")
def expired_leases(spark, sf_dir):
    ends = F.col("ts") + F.expr("INTERVAL 15 MINUTE")
    return _t(spark, sf_dir, "events").filter((F.col("event_type") == "view") & (ends <= F.lit("2024-01-03").cast("timestamp_ntz"))).select("event_id", "user_id")


@query("b48_orphans", "SELECT l_partkey AS placeholder, count(*) AS comments, min(l_orderkey) AS first FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) GROUP BY 1")
def orphans(spark, sf_dir):
    posts = _t(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return _t(spark, sf_dir, "lineitem").join(posts, "l_partkey", "left_anti").groupBy(F.col("l_partkey").alias("placeholder")).agg(F.count("*").alias("comments"), F.min("l_orderkey").alias("first"))


@query("b49_auxiliary_import", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, greatest(value - 10, 0) AS scroll,
CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'retry' WHEN 'signup' THEN 'dead' ELSE 'pending' END AS state, d.doc_id IS NULL AS placeholder, coalesce(TRY_CAST(json_extract_string(props, '$.at') AS TIMESTAMP), TIMESTAMP '2024-02-01') AS saved_at
FROM events LEFT JOIN documents d ON d.doc_id = event_id""")
def auxiliary_import(spark, sf_dir):
    """Legacy rows: positions from 1, scroll floored at 0, states mapped, missing posts as placeholders, unreadable dates as the time of import."""
    known = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.lit(True).alias("known"))
    rows = relational.numbered(_t(spark, sf_dir, "events"), F.col("ts"), F.col("event_id"), keys=["user_id"]).join(known, "event_id", "left")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "signup", "dead").otherwise("pending")
    at = F.coalesce(F.get_json_object("props", "$.at").try_cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return rows.select("event_id", F.col("place").cast("long").alias("position"), F.greatest(F.col("value") - 10, F.lit(0.0)).alias("scroll"), state.alias("state"), F.col("known").isNull().alias("placeholder"), at.alias("saved_at"))


@query("b50_slot_sums", "SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS attempts, coalesce(sum(l_quantity), 0)::BIGINT AS pages FROM lineitem WHERE l_linestatus = 'O'")
def slot_sums(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return rows.agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long").alias("pages"))


@query("b51_outbox_totals", "SELECT count(*) AS n, coalesce(sum(octet_length(encode(props))), 0)::BIGINT AS bytes FROM events WHERE event_type = 'nothing'")
def outbox_totals(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter("event_type = 'nothing'").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).alias("bytes"))


@query("b52_console_overview", """SELECT 'tables' AS part, 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'tables', 'events', count(*) FROM events UNION ALL SELECT 'queue', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'runs', event_id::VARCHAR, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""")
def console_overview(spark, sf_dir):
    orders, events = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "events")
    tables = [t.agg(F.lit("tables").alias("part"), F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in (("orders", orders), ("events", events))]
    states = orders.groupBy(F.lit("queue").alias("part"), F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    runs = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select(F.lit("runs").alias("part"), F.col("event_id").cast("string").alias("name"), F.col("user_id").alias("n"))
    return tables[0].unionAll(tables[1]).unionAll(states).unionAll(runs)


@query("b54_merged_reports", """WITH s AS (SELECT user_id, event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS n FROM events GROUP BY 1, 2)
SELECT e.user_id, max(event_id) AS last, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 50)), ',') AS codes, max(event_id) FILTER (event_type = 'view') AS selected_run,
 (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM s WHERE s.user_id = e.user_id) AS counters FROM events e GROUP BY e.user_id""")
def merged_reports(spark, sf_dir):
    reports = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("counters"), F.when(F.col("value") > 50, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("codes"))
    merged = coverage.merge_reports(reports, "user_id", "event_id", "event_id", F.col("event_type") == "view")
    text = F.array_join(F.transform(F.map_entries("counters"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return merged.select("user_id", "last", F.nullif(F.array_join("codes", ","), F.lit("")).alias("codes"), "selected_run", text.alias("counters"))


@query("b55_result_codes", """WITH r AS (SELECT user_id, list(DISTINCT event_type) AS codes, max(CASE WHEN value > 99 THEN 'bad code' WHEN value > 97 THEN 'given' END) AS given FROM events GROUP BY 1), c AS (SELECT *, CASE WHEN list_contains(codes, 'error') THEN 'site_error' WHEN list_contains(codes, 'click') THEN 'slow' END AS warning FROM r)
SELECT user_id, warning, CASE WHEN regexp_matches(coalesce(given, warning, 'run_failed'), '^[a-zA-Z0-9_.:-]{1,128}$') THEN coalesce(given, warning, 'run_failed') ELSE 'run_failed' END AS code FROM c""")
def result_codes(spark, sf_dir):
    given = F.max(F.when(F.col("value") > 99, "bad code").when(F.col("value") > 97, "given"))
    runs = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("codes"), given.alias("given"))
    warning = coverage.warning(F.col("codes"), {"error": "site_error", "click": "slow"})
    return runs.select("user_id", warning.alias("warning"), coverage.safe_code(F.col("given"), F.coalesce(warning, F.lit("run_failed"))).alias("code"))
