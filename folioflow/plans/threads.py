"""Queries of threads, wrapped bodies, stable codes, board works, single claims and marks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import bodies, codes, dates, listings, sanitise, threads, titles
from folioflow.operators import merge, queue, reading, relational, search, works
from folioflow.sources import store


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@query("d1_clean_pages")
def clean_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", sanitise.clean_html("html").alias("clean"))


@query("d6_comment_parents", """WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 4)::INT AS position, l_partkey % 4 AS depth FROM lineitem)
SELECT l_orderkey, position, (SELECT max(b.position) FROM c b WHERE b.l_orderkey = a.l_orderkey AND b.position < a.position AND b.depth < a.depth) AS parent FROM c a""")
def comment_parents(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("depth")).alias("c"))
    pages = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c"))["depth"].alias("depths"))  # the comments of one page
    rows = pages.select("l_orderkey", F.posexplode(threads.comment_parents("depths")).alias("position", "parent"))
    return rows.withColumn("position", F.col("position") + 1)


@query("d14_repaired_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 9 HOUR END AS created_at FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 3 = 1""")
def repaired_dates(spark, sf_dir):
    ident, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(ident % 3 == 0, F.col("o_orderdate")).alias("created_at"), F.when(ident % 3 == 1, day).otherwise("soon").alias("raw"), F.lit("2024-03-01").cast("timestamp").alias("seen_at"))
    return dates.repaired(rows, "created_at", "raw", "seen_at").filter("created_at IS NOT NULL").select("o_orderkey", "created_at")


@query("d21_board_bodies", r"""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN chr(10) || source || chr(10) || '[image] media:2024/0123456789abcdef.webp' || chr(10) || '[image] https://elsewhere.org/2024/0123456789abcdef.webp' END AS body FROM documents WHERE source IS NOT NULL""")
def board_bodies(spark, sf_dir):
    image = "2024/0123456789abcdef.webp"
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "no head").otherwise("# title\r\n- author: a"), F.lit("\r\n---\r\n\n"), "source", F.lit(f"\n[image] https://img.example.org/{image}?expires=1&key=2\n[image] https://elsewhere.org/{image}"))
    return _t(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", bodies.board_body(raw, ("example.org",)).alias("body"))


@query("d22_same_bodies", "SELECT doc_id, doc_id % 2 = 0 AND doc_id % 5 <> 0 AS same FROM documents WHERE source IS NOT NULL")
def same_bodies(spark, sf_dir):
    ident = F.col("doc_id")
    stored = F.concat("source", F.lit("\n"))
    incoming = F.concat(F.lit("# t\r\n# https://example.org/1\r\n\r\n"), "source", F.when(ident % 2 == 0, "\r\n").otherwise("!\n"))
    sha = F.when(ident % 5 == 0, "gone").otherwise(F.sha2(stored, 256))
    return _t(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", bodies.same_body(stored, sha, incoming, bodies.canonical_body).alias("same"))


@query("d29_segments", """SELECT conv_id, string_agg('──── #' || turn || ' ' || role || ' · ' || strftime(TIMESTAMP '2024-01-01 05:30:00' + turn * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') || chr(10) || coalesce(text, '') ||
 CASE WHEN turn % 2 = 0 THEN chr(10) || '[image] https://example.org/' || turn ELSE '' END, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY 1""")
def segments(spark, sf_dir):
    turn = F.col("turn")
    rows = _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", (_ntz("2023-12-31 20:30:00") + F.make_dt_interval(hours=turn.cast("int"))).alias("at"), F.concat(F.lit("[bld]"), F.coalesce("text", F.lit("")), F.lit("[/bld]\n")).alias("content"),
        F.when(turn % 2 == 0, F.concat(F.lit("https://example.org/"), turn.cast("string"))).otherwise("none").alias("attachment"),
    )
    return threads.segment_texts(rows, ["conv_id"], "turn", "role", "at", "content", "attachment")


@query("d34_seeded_numbers", """WITH w AS (SELECT n_name, d, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(n_name, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM nation, range(1, 4) t(d)),
s AS (SELECT *, (h + d * 1831565813::HUGEINT) % 4294967296 AS s FROM w), a AS (SELECT *, (xor(s, s // 32768) * (s | 1)) % 4294967296 AS a FROM s), b AS (SELECT *, xor((a + xor(a, a // 128) * (a | 61)) % 4294967296, a) AS b FROM a)
SELECT n_name, d AS draw, round(xor(b, b // 16384) / 4294967296, 9) AS number FROM b""")
def seeded_numbers(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select("n_name", F.explode(F.array(*(F.lit(d).cast("long") for d in (1, 2, 3)))).alias("draw"))
    return rows.select("n_name", "draw", F.round(codes.seeded_number(F.col("n_name"), F.col("draw")), 9).alias("number"))


@query("d43_scene_headers", "SELECT doc_id, doc_id % 2 = 0 AS header FROM documents")
def scene_headers(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" 12: a"), ident, F.lit(" :2024/1/2 10:00"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("──── #7 a"), ident, F.lit(" · 2024-01-02 10:00"))).otherwise(F.concat(F.lit("#7 "), ident))
    return _t(spark, sf_dir, "documents").select("doc_id", threads.is_scene_header(line).alias("header"))


@query("d44_wrapped_bodies", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || chr(10) || 'x' END AS text, 'https://example.org/' || doc_id AS source_url FROM documents WHERE source IS NOT NULL""")
def wrapped_bodies(spark, sf_dir):
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))
    novel = bodies.novel_wrapper(F.concat(F.lit("# title\r\n# "), url, F.lit("\r\n\r\n \n"), "source"))
    board = bodies.board_wrapper(F.concat(F.lit("# title\n- author: a\n- url: "), url, F.lit("\n---\n\n"), "source", F.lit("\nx")))
    rows = _t(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 2 == 0, novel).otherwise(board).alias("b"))
    return rows.select("doc_id", "b.text", "b.source_url")


@query("d45_stable_props", """SELECT event_id, '{"a":[2,{"b":1,"c":null}],"type":"' || event_type || '"}' AS props FROM events""")
def stable_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", codes.stable_json(F.concat(F.lit('{"type": "'), "event_type", F.lit('", "a": [2, {"c": null, "b": 1}]}'))).alias("props"))


@query("a19_json_lines", """SELECT c_custkey, '{"balance":null,"name":"' || c_name || ' 용사","segment":"' || c_mktsegment || '"}' || chr(10) AS line FROM customer""")
def json_lines(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", codes.json_line(segment=F.col("c_mktsegment"), name=F.concat("c_name", F.lit(" 용사")), balance=F.lit(None).cast("double")).alias("line"))


@query("a8_restore_faults", "SELECT 'customer' AS name, 'count' AS fault UNION ALL SELECT 'nation', 'content' UNION ALL SELECT 'region', 'missing'")
def restore_faults(spark, sf_dir):
    tables = {name: _t(spark, sf_dir, name) for name in ("customer", "nation", "region", "supplier")}
    restored = {"customer": tables["customer"].filter("c_custkey > 0"), "nation": tables["nation"].withColumn("n_name", F.lower("n_name")), "supplier": tables["supplier"].repartition(3)}

    def manifests(frames):
        first, *rest = (store.manifest(frame, name) for name, frame in frames.items())
        for other in rest:
            first = first.unionByName(other)
        return first

    return store.restore_faults(manifests(tables), manifests(restored))


_BOARD = """WITH p AS (SELECT o_orderpriority AS board, o_orderstatus AS category, o_orderkey // 2 AS id, CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'both' ELSE 'image' END AS lane,
 'story ' || chr(97 + (o_custkey % 20)::INT) AS base, o_orderkey % 40 AS ep, CASE WHEN o_custkey % 101 = 0 THEN ' ' ELSE 'a' || (o_custkey % 3) END AS author, o_orderkey AS seen FROM orders),
c AS (SELECT * FROM p WHERE lane <> 'image' QUALIFY row_number() OVER (PARTITION BY board, category, id ORDER BY lane = 'text' DESC, seen DESC) = 1),
e AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY board, category, base, ep) = 1)
SELECT board, category, base, min_by(author, ep) AS author, count(*) AS chapters, max(seen) AS last_at FROM e GROUP BY board, category, base HAVING count(*) > 1 AND count(*) FILTER (trim(author) = '') = 0"""


@query("e12_board_works", _BOARD)
def board_works(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    title = F.concat(F.lit("Story "), F.char(97 + customer % 20), F.lit(" "), (key % 40 + 1).cast("string"), F.lit("화"))
    posts = _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("board"), F.col("o_orderstatus").alias("category"), F.floor(key / 2).alias("id"), F.when(key % 3 == 0, "text").when(key % 3 == 1, "both").otherwise("image").alias("lane"),
        F.when(customer % 101 == 0, " ").otherwise(F.concat(F.lit("a"), (customer % 3).cast("string"))).alias("author"), key.alias("at"), titles.parse(titles.folded(title)).alias("found"),
    )
    order = F.when(F.col("found.label").isNotNull(), F.struct("found.season", "found.volume", "found.class", "found.start", "found.end"))
    return works.board_works(posts, "board", "category", "id", "lane", "author", "at", F.col("found.base"), order).select("board", "category", "base", "author", "chapters", "last_at")


@query("e18_filled_authors", """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN nullif(trim(lang), '') END, CASE WHEN doc_id % 2 = 0 THEN source END) AS author, coalesce(CASE WHEN doc_id % 4 = 0 THEN lang END, '미분류') AS category FROM documents""")
def filled_authors(spark, sf_dir):
    ident, docs = F.col("doc_id"), _t(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(ident % 3 == 0, " ").when(ident % 3 == 1, F.col("lang")).otherwise("-").alias("author"), F.lit(None).cast("string").alias("category"))
    headers = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("source").alias("author"), F.when(ident % 4 == 0, F.col("lang")).otherwise("-").alias("category"))
    return works.filled_from_headers(rows, headers, "doc_id", {"author": None, "category": "미분류"})


@query("f17_heartbeats", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def heartbeats(spark, sf_dir):
    return relational.latest_per(_t(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "ts")


@query("f19_media_ledger", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS status FROM documents")
def media_ledger(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("status"), F.lit(1).alias("stored_at"))
    incoming = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("status"), F.lit(2).alias("stored_at"))
    return merge.overwrite(docs, incoming, ["doc_id"], "stored_at").select("doc_id", "status")


def _queue(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "pending").otherwise("dead")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("board"), F.col("o_orderkey").alias("id"), status.alias("state"), F.lit(2).alias("attempts"), F.lit("http").alias("last_error_code"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"), F.when(status == "running", F.col("o_orderdate").cast("timestamp")).alias("lease_expires_at"),
    )


@query("g3_claim_one", "SELECT o_orderkey AS id, 3 AS attempts FROM orders WHERE o_orderkey = 1 AND (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1999-01-01')) AND o_orderpriority <> '5-LOW'")
def claim_one(spark, sf_dir):
    disabled = spark.range(1).select(F.lit("5-LOW").alias("board"))
    return queue.claim_one(_queue(spark, sf_dir), {"id": 1}, F.lit("1999-01-01").cast("timestamp"), 60, disabled).select("id", "attempts")


@query("g27_requeue_given", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'pending' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'pending' ELSE 'dead' END END AS state, CASE WHEN o_orderstatus <> 'O' AND o_custkey % 2 = 0 THEN 0 ELSE 2 END AS attempts FROM orders")
def requeue_given(spark, sf_dir):
    given = _t(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(F.col("o_orderpriority").alias("board"), F.col("o_orderkey").alias("id"))
    return queue.requeue_given(_queue(spark, sf_dir), given, ["board", "id"]).select("id", "state", "attempts")


@query("c18_excerpt_markdown", """SELECT conv_id, turn, '> ' || replace(role || chr(10) || 'end', chr(10), chr(10) || '> ') || chr(10) || chr(10) || CASE WHEN turn = 0 THEN 'note' || chr(10) || chr(10) ELSE '' END || '— ' || conv_id || ' › ' || turn || ' · 2024-01-02' || chr(10) || chr(10) || '---' || chr(10) AS markdown FROM conversations""")
def excerpt_markdown(spark, sf_dir):
    text = search.excerpt_markdown(F.concat("role", F.lit("\nend")), F.when(F.col("turn") == 0, "note"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("markdown"))


@query("c19_annotation_at", """WITH m AS (SELECT l_suppkey AS d, l_partkey * 7 AS a, l_partkey * 7 + l_quantity::BIGINT * 40 AS z, l_orderkey * 10 + l_linenumber AS id FROM lineitem), q AS (SELECT DISTINCT l_suppkey AS d, l_orderkey * 3 AS o FROM lineitem)
SELECT q.d AS document, q.o AS place, max(id) AS annotation FROM q LEFT JOIN m ON q.d = m.d AND q.o >= m.a AND q.o < m.z GROUP BY 1, 2""")
def annotation_at(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 7
    marks = lines.select(F.col("l_suppkey").alias("document"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 40).alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    lookups = lines.select(F.col("l_suppkey").alias("document"), (F.col("l_orderkey") * 3).alias("place")).distinct()
    return search.annotation_at(lookups, marks.withColumn("at", F.col("id")), "document", "place", "start", "stop", "at", "id")


@query("j23_pick_of_the_day", """WITH h AS (SELECT list_reduce(list_prepend(0::HUGEINT, list_transform(string_split('2024-05-06', ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
SELECT doc_id FROM r, h WHERE place = h % (SELECT count(*) FROM documents)""")
def pick_of_the_day(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    return docs.orderBy("doc_id").offset(reading.pick_of_the_day("2024-05-06", docs.count())).limit(1)


@query("d24_catalogue_pages", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'duplicate_id' WHEN 2 THEN 'rows_rejected' ELSE 'shape_unknown' END AS fault, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS total, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS title FROM orders""")
def catalogue_pages(spark, sf_dir):
    ident = F.col("o_orderkey")
    second = F.when(ident % 4 == 0, '"2"').when(ident % 4 == 1, '"1"').otherwise('"x"')
    page = F.concat(F.lit('{"data": {"total": '), F.col("o_custkey").cast("string"), F.when(ident % 4 == 3, F.lit(', "rows": [{"id": 1, "title": "')).otherwise(', "items": [{"id": 1, "title": "'), "o_orderpriority", F.lit('", "secret": 1}, {"id": '), second, F.lit("}]}}"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", listings.catalogue_page(page).alias("p"))
    return rows.select("o_orderkey", "p.fault", "p.total", F.get("p.works", F.lit(0))["title"].alias("title"))


@query("d25_work_details", """SELECT p_partkey, 'free' AS access_1, CASE WHEN p_size % 2 = 0 THEN 'point' ELSE 'unknown' END AS access_2, p_size + 0.5 AS number_2, 2::INT AS place_2, (p_size || '.5') AS label_2 FROM part""")
def work_details(spark, sf_dir):
    size = F.col("p_size").cast("string")
    detail = F.concat(
        F.lit('{"data": {"work": {"id": 7, "title": "t"}, "episodes": [{"id": 1, "price": 0, "title": "a"}, {"id": "no"}, {"id": 3, "episodeNumber": '), size, F.lit('.50, "isFree": '), F.when(F.col("p_size") % 2 == 0, "false").otherwise("null"), F.lit("}]}}")
    )
    rows = _t(spark, sf_dir, "part").select("p_partkey", listings.work_detail(detail)["episodes"].alias("e"))
    return rows.select("p_partkey", F.col("e")[0]["access"].alias("access_1"), F.col("e")[1]["access"].alias("access_2"), F.col("e")[1]["number"].cast("double").alias("number_2"), F.col("e")[1]["toc_position"].alias("place_2"), F.col("e")[1]["label"].alias("label_2"))


@query("d26_thread_records", """SELECT CASE event_id % 3 WHEN 0 THEN 'dropped' WHEN 1 THEN 'fine' ELSE 'invalid' END AS status, count(*) AS n, count(*) FILTER (event_id % 3 = 1) AS titled FROM events WHERE event_id > 0 GROUP BY 1""")
def thread_records(spark, sf_dir):
    ident = F.col("event_id")
    raw = F.concat(
        F.lit('{"id": '), ident.cast("string"), F.lit(', "title": "t", "username": "u", "password": "p", "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-01T00:00:00Z", "responseCount": 3, "ended": '),
        F.when(ident % 3 == 2, '"maybe"').otherwise("false"), F.lit(', "deleted": '), F.when(ident % 3 == 0, "true").otherwise("false"), F.lit("}"),
    )
    rows = _t(spark, sf_dir, "events").filter("event_id > 0").select(listings.thread_record(raw).alias("r"))
    return rows.groupBy(F.col("r.status").alias("status")).agg(F.count("*").alias("n"), F.count("r.title").alias("titled"))
