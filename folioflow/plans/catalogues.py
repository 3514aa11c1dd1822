"""Work, catalogue, page and text-function queries over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import dates, markup, titles
from folioflow.functions import text as tx
from folioflow.operators import search, works
from folioflow.sources import store


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PREVIEW = """WITH r AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name, p_size) AS c FROM part),
k AS (SELECT *, CASE WHEN p_size IS NULL THEN 'no_episode' WHEN length(p_name) < 9 THEN 'short_title' END AS early FROM r),
l AS (SELECT *, count(*) FILTER (early IS NULL) OVER (PARTITION BY p_brand, p_name, p_size) AS again FROM k),
m AS (SELECT *, coalesce(early, CASE WHEN c > 1 THEN 'repeated_episode' END) AS reason FROM l),
s AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY p_brand, p_name) AS whole FROM m),
z AS (SELECT *, coalesce(reason, CASE WHEN whole < 2 THEN 'single' END) AS why FROM s) """


def _preview(spark, sf_dir):
    """Parts as posts: the brand is the board, the name the base title and the size the episode."""
    return works.preview(_t(spark, sf_dir, "part"), ["p_brand"], F.col("p_name"), F.col("p_size"), "p_partkey", shortest=9)


@query("e1_collection_preview", _PREVIEW + """SELECT p_brand, base, p_partkey, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_size, p_partkey)::INT AS position FROM (SELECT *, p_name AS base FROM z WHERE why IS NULL)""")
def collection_preview(spark, sf_dir):
    return _preview(spark, sf_dir)[0].select("p_brand", "base", "p_partkey", "position")


@query("e1_rejections", _PREVIEW + "SELECT why AS reason, count(*) AS n FROM z WHERE why IS NOT NULL GROUP BY 1")
def rejections(spark, sf_dir):
    return _preview(spark, sf_dir)[1]


def _chapters(spark, sf_dir):
    """Documents as chapters: a source is a site and each of its languages one of its works."""
    return _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat_ws(":", "source", "lang").alias("work"), tx.content_hash(F.col("text")).alias("sha"))


@query("e4_pair_copies", """WITH c AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS sha FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang, sha, source ORDER BY doc_id) AS copy FROM c)
SELECT min(doc_id) AS representative, count(*) AS variants FROM k GROUP BY lang, sha, copy""")
def pair_copies(spark, sf_dir):
    return works.pair_copies(_chapters(spark, sf_dir), ["lang"], "sha", "source", [], "doc_id").select("representative", "variants")


_LINKS = """WITH RECURSIVE c AS (SELECT source, lang, concat_ws(':', source, lang) AS work, sha256(coalesce(text, '')) AS sha FROM documents),
m AS (SELECT source, lang, sha, min(work) AS work FROM c GROUP BY ALL HAVING count(DISTINCT work) = 1),
l AS (SELECT a.work AS left_work, b.work AS right_work, count(DISTINCT sha) AS shared FROM m a JOIN m b USING (lang, sha) WHERE a.source < b.source GROUP BY ALL) """


def _links(spark, sf_dir):
    return works.link_basis(_chapters(spark, sf_dir), "work", "source", "lang", "sha", least=1)


@query("e5_link_basis", _LINKS + "SELECT * FROM l")
def link_basis(spark, sf_dir):
    return _links(spark, sf_dir)


@query("e6_merged_works", _LINKS + """, e AS (SELECT left_work AS a, right_work AS b FROM l UNION SELECT right_work, left_work FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id, min(seen) AS canonical FROM r GROUP BY id""")
def merged_works(spark, sf_dir):
    return works.merge_links(_links(spark, sf_dir), "left_work", "right_work")


@query("e10_chapter_order", """WITH f AS (SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_linestatus) = 1 AND count(DISTINCT l_linenumber) = count(*) AS by_source FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, l_extendedprice, by_source, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN by_source THEN l_linenumber END NULLS FIRST, l_partkey, l_extendedprice, l_suppkey)::INT AS place
FROM lineitem JOIN f USING (l_orderkey)""")
def chapter_order(spark, sf_dir):
    rows = works.chapter_order(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", [F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_suppkey")])
    return rows.select("l_orderkey", "l_partkey", "l_extendedprice", "by_source", "place")


@query("e11_latest_label", "SELECT conv_id, coalesce(arg_max(role, turn) FILTER (role = 'user'), arg_max(role, turn)) AS latest_label FROM conversations GROUP BY conv_id")
def latest_label(spark, sf_dir):
    return works.latest_label(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", F.col("role") == "user")


@query("c3_popular", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def popular(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(50)


@query("c6_on_this_day", "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) = 3 AND day(o_orderdate) = 14 AND year(o_orderdate) < 1999")
def on_this_day(spark, sf_dir):
    return search.on_this_day(_t(spark, sf_dir, "orders"), "o_orderdate", F.lit("1999-03-14").cast("date")).select("o_orderkey", "o_orderdate")


@query("c6_hot", """SELECT o_orderkey FROM (SELECT *, substr(o_orderpriority, 1, 1)::INT - 1 AS n FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000)
WHERE n > 0 ORDER BY n DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def hot(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("n", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return search.hot(orders, "o_orderdate", "o_orderkey", "n", "o_totalprice").select("o_orderkey")


@query("c7_resolve", "SELECT place::INT AS place, w.doc_id, source FROM (VALUES (0, 5), (1, -1), (2, 3), (3, 5)) w(place, doc_id) LEFT JOIN documents d ON d.doc_id = w.doc_id")
def resolve(spark, sf_dir):
    return search.resolve(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", [5, -1, 3, 5])


@query("c8_board_kind", "SELECT p_brand, CASE WHEN bool_and(p_size > 3) THEN 'all' WHEN NOT bool_or(p_size > 3) THEN 'none' END AS kind FROM part GROUP BY 1")
def board_kind(spark, sf_dir):
    return search.board_kind(_t(spark, sf_dir, "part"), "p_brand", F.col("p_size") > 3)


@query("c15_keyword_in_context", """WITH s AS (SELECT doc_id, text, string_split(lower(text), 'license') AS p FROM documents WHERE contains(lower(text), 'license')),
h AS (SELECT *, unnest(range(1, len(p))) AS k FROM s), b AS (SELECT *, list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + (k - 1) * 7 AS start FROM h)
SELECT doc_id AS id, k::INT - 1 AS hit, start, text[greatest(0, start - 36) + 1 : start] AS before, text[start + 1 : start + 7] AS exact, text[start + 8 : start + 43] AS after FROM b""")
def keyword_in_context(spark, sf_dir):
    return search.keyword_in_context(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "license")


@query("c21_folder_totals", "SELECT source, lang, count(*) AS n, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY ALL")
def folder_totals(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("bytes"))


_VIEWS = {"long_english": "lang = 'en' AND n_chars > 2000", "short": "n_chars < 300", "first_source": "source = 'src0'", "all": "true"}


@query("c24_smart_views", " UNION ALL ".join(f"SELECT '{name}' AS view, count(*) FILTER ({rule}) AS n FROM documents" for name, rule in _VIEWS.items()))
def smart_views(spark, sf_dir):
    return search.smart_views(_t(spark, sf_dir, "documents"), {name: F.expr(rule) for name, rule in _VIEWS.items()})


@query("c27_term_index", """WITH t AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\f\\r]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS places, strlen(term)::BIGINT AS bytes FROM t WHERE term <> '' GROUP BY term""")
def term_index(spark, sf_dir):
    return search.term_index(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("d2_page_text")
def page_text(spark, sf_dir):
    """Readable text and its hash per page; a markup parser has no SQL, tests compare it with written cases."""
    text = _t(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text"))
    return text.select("page_id", F.length("text").cast("long").alias("n_chars"), tx.content_hash(F.col("text")).alias("sha"))


@query("d7_page_links", """WITH l AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, unnest(links) AS link, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, unnest(range(len(links)))::INT AS place FROM l""")
def page_links(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), F.posexplode(markup.targets(F.col("html"), "a", "href")).alias("place", "link"))
    return pages.select("page_id", "origin", "place", "link")


@query("d8_url_identity", """SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/[0-9]+', 1), '') AS board,
TRY_CAST(regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS BIGINT) AS post FROM pages""")
def url_identity(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select(
        "page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/\d+", 1), F.lit("")).alias("board"),
        F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/(\d+)", 1).try_cast("long").alias("post"),
    )


@query("d13_source_dates", """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN TIMESTAMP '2024-03-01 03:00:00' - (1 + day(o_orderdate)) * INTERVAL 1 DAY
ELSE o_orderdate - INTERVAL 9 HOUR END AS published_at FROM orders""")
def source_dates(spark, sf_dir):
    """Order dates written in five of the forms of the sources, read back as UTC."""
    day, kind = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    raw = (
        F.when(kind == "1", F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(kind == "2", F.date_format(day, "yyyy.MM.dd")).when(kind == "3", F.date_format(day, "yyyy/MM/dd HH:mm"))
        .when(kind == "4", F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).otherwise(F.concat((1 + F.day(day)).cast("string"), F.lit("일 전")))
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.source_time(raw, F.lit("2024-03-01 03:00:00").cast("timestamp")).cast("timestamp_ntz").alias("published_at"))


@query("d33_cover_hue", """SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS hash FROM part""")
def cover_hue(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", titles.fnv1a(F.col("p_name")).alias("hash"))


@query("d37_reading_minutes", "SELECT doc_id, greatest(1, floor(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) / 500.0 + 0.5))::BIGINT AS minutes FROM documents")
def reading_minutes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", titles.reading_minutes(F.col("text")).alias("minutes"))


@query("h19_link_inventory", """WITH l AS (SELECT unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS link, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)
SELECT origin || link AS target, count(*) AS n FROM l WHERE link LIKE '/%' AND link NOT LIKE '//%' GROUP BY 1""")
def link_inventory(spark, sf_dir):
    links = _t(spark, sf_dir, "pages").select("url", F.explode(markup.targets(F.col("html"), "a", "href")).alias("link"))
    rooted = links.filter("link LIKE '/%' AND link NOT LIKE '//%'")
    return rooted.groupBy(markup.resolved(F.col("url"), F.col("link")).alias("target")).agg(F.count("*").alias("n"))


@query("a5_dangling_keys", """SELECT 'orders' AS name, (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS dangling
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'labels', (SELECT count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents))""")
def dangling_keys(spark, sf_dir):
    keys = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    return store.dangling(spark, {name: _t(spark, sf_dir, name) for name in ("orders", "customer", "lineitem", "labels", "documents")}, keys)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings")


@query("a6_row_counts", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {name}" for name in _TABLES))
def row_counts(spark, sf_dir):
    return store.row_counts({name: _t(spark, sf_dir, name) for name in _TABLES})


@query("v1_repeated_keys", "SELECT user_id, props, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return store.repeated(_t(spark, sf_dir, "events"), ["user_id", "props"])
