"""Queries of validators, labels, keys and schemas on the columns of the given tables, each with SQL that computes the rule itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import bodies, hangul, titles
from folioflow.operators import merge, release, suggest, works
from folioflow.sources import captures
from folioflow.sources.migrations import Schema, Step
from folioflow.sources.shared import materialise, own_dir, temporary


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FIRST = {"orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "nation": "n_nationkey int, n_name string, n_regionkey int"}
_STEPS = [
    Step("orders", "add", "channel", "string", default="web"), Step("orders", "rename", "o_orderstatus", to="state"), Step("nation", "widen", "n_nationkey", "bigint"),
    Step("orders", "drop", "o_orderpriority"), Step("nation", "add", "board", "string"), Step("nation", "rename", "n_name", to="name"),
]


@query("a3_read_through", """SELECT o_orderkey, o_custkey, o_orderstatus AS state, o_totalprice, 'web' AS channel, n.n_nationkey::BIGINT AS n_nationkey, n.n_name AS name, NULL::VARCHAR AS board
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey""")
def read_through(spark, sf_dir):
    """Tables of the first version, read as today's through the steps since then."""
    schema = Schema(spark, _FIRST, _STEPS)
    orders, nation = (schema.read(name, _t(spark, sf_dir, name).select([c.split()[0] for c in _FIRST[name].split(", ")]), 0) for name in _FIRST)
    customer = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n_nationkey"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, "n_nationkey")
    return rows.select("o_orderkey", "o_custkey", "state", "o_totalprice", "channel", "n_nationkey", "name", "board")


@query("h5_ordered_fingerprint", """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS place, doc_id, lang FROM documents)
SELECT source, count(*) AS n, sum(('0x' || substr(md5(place || chr(31) || coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || lang, '-')), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM r GROUP BY source""")
def ordered_fingerprint(spark, sf_dir):
    return release.ordered_fingerprint(_t(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], "doc_id", "lang")


@query("d3_required_texts", "SELECT doc_id, nullif(trim(source), '') AS source, nullif(trim(lang), '') AS lang, nullif(trim(substr(text, 5, 1)), '') AS blank FROM documents")
def required_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", bodies.required_text(F.col("source")).alias("source"), bodies.optional_text(F.col("lang")).alias("lang"), bodies.required_text(F.substring("text", 5, 1)).alias("blank"))


@query("d4_post_faults", r"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^(https?)://([^/]+)/', 2) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS board, TRY_CAST(regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS BIGINT) AS id,
 trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(board, '^[a-z0-9_]{1,64}$'), false) THEN 'board_id' WHEN NOT coalesce(id > 0, false) THEN 'external_post_id'
 WHEN NOT (url IN ('https://' || host || '/' || board || '/' || id) AND host IN ('blog.tionsh.example.net', 'thther.example.org')) THEN 'canonical_url' WHEN title = '' THEN 'title' WHEN trim(coalesce(html, '')) = '' THEN 'body' WHEN length(html) % 2 = 1 THEN 'views' END AS fault FROM p""")
def post_faults(spark, sf_dir):
    """The first fault of pages as captured posts: their own addresses, titles and texts."""
    url, html = F.col("url"), F.col("html")
    row = {
        "outcome": F.lit("stored"), "board_id": F.regexp_extract(url, r"^https?://[^/]+/([a-z]+)/", 1), "external_post_id": F.nullif(F.regexp_extract(url, r"^https?://[^/]+/[a-z]+/([0-9]+)", 1), F.lit("")).try_cast("long"),
        "canonical_url": url, "title": F.regexp_extract(html, "<title>([^<]*)</title>", 1), "body_text": html, "views": F.when(F.length(html) % 2 == 1, -1).otherwise(1),
    }
    return _t(spark, sf_dir, "pages").select("page_id", bodies.post_fault(row, ("blog.tionsh.example.net", "thther.example.org")).alias("fault"))


@query("d5_comment_faults", """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN turn ELSE turn + 1 END AS position, substr(text, 1, 1) AS ident, CASE WHEN role <> 'user' THEN turn - 1 END AS parent, CASE WHEN role = 'user' OR length(text) % 7 = 0 THEN 0 ELSE 1 END AS depth FROM conversations),
f AS (SELECT conv_id, bool_or(NOT coalesce(position > 0, false)) AS p, count(DISTINCT position) < count(position) AS rp, count(DISTINCT ident) < count(ident) AS ri, bool_or((depth = 0) <> (parent IS NULL)) AS d FROM c GROUP BY 1),
o AS (SELECT conv_id, bool_or(NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.position = c.parent) OR parent >= position) AS o FROM c WHERE parent IS NOT NULL GROUP BY 1)
SELECT conv_id, CASE WHEN p THEN 'position' WHEN rp THEN 'repeated_position' WHEN ri THEN 'repeated_id' WHEN d THEN 'depth' WHEN o THEN 'parent' END AS fault FROM f LEFT JOIN o USING (conv_id)""")
def comment_faults(spark, sf_dir):
    """The first fault of each conversation's turns as comments."""
    role, turn = F.col("role"), F.col("turn")
    one = F.struct(
        F.when(role == "assistant", turn).otherwise(turn + 1).alias("position"), F.substring("text", 1, 1).alias("source_comment_id"),
        F.when(role != "user", turn - 1).alias("parent_position"), F.when((role == "user") | (F.length("text") % 7 == 0), 0).otherwise(1).alias("depth"),
    )
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("comments"))  # a post's comments are checked together
    return rows.select("conv_id", bodies.comment_fault(F.col("comments")).alias("fault"))


_KINDS = {"script": "<script", "table": "<table", "list": "<li>", "quote": "&amp;"}


@query("d10_page_kinds", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)%s') THEN 'script' WHEN regexp_matches(html, '(?i)%s') THEN 'table' WHEN regexp_matches(html, '(?i)%s') THEN 'list' WHEN regexp_matches(html, '(?i)%s') THEN 'quote' ELSE 'content' END AS kind FROM pages" % tuple(_KINDS.values()))
def page_kinds(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", bodies.page_kind(F.col("html"), _KINDS).alias("kind"))


@query("d16_display_titles", r"""WITH t AS (SELECT p_partkey, upper(p_name) || ' ' || p_size || '화' AS title FROM part) SELECT p_partkey, regexp_replace(title, '\s*[0-9]+화$', '') AS shown FROM t""")
def display_titles(spark, sf_dir):
    """Names of parts as titles in upper case, whose size is the episode."""
    title = F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("화"))
    return _t(spark, sf_dir, "part").select("p_partkey", titles.display_title(title, titles.parse(titles.folded(title))["label"]).alias("shown"))


@query("d17_text_keys", r"SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9_]+', '', 'g') AS name_key, regexp_replace(lower(c_mktsegment), '[^a-z0-9_]+', '', 'g') AS segment_key FROM customer")
def text_keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", titles.key(F.col("c_name")).alias("name_key"), titles.key(F.col("c_mktsegment")).alias("segment_key"))


_SIGNS = "CASE o_custkey % 4 WHEN 0 THEN '화' WHEN 1 THEN ' 話' WHEN 2 THEN '회' ELSE '편' END"


@query("d36_episode_gaps", f"""WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority || ' ' || (o_orderkey % 5) || '회차 ' || (o_orderkey % 97) || {_SIGNS} || CASE WHEN o_orderkey % 3 = 0 THEN ' 2회차' ELSE '' END AS label FROM orders),
n AS (SELECT *, list_extract(regexp_extract_all(regexp_replace(label, '[0-9]+회차', '', 'g'), '([0-9]+)\\s*(?:화|話|회)', 1), -1)::BIGINT AS number FROM l),
w AS (SELECT *, lead(number) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM n)
SELECT o_orderkey, number, coalesce(greatest(0, following - number - 1), 0)::BIGINT AS gap FROM w""")
def episode_gaps(spark, sf_dir):
    """Numbers of labels in which rounds are counted, too, and the episodes between a customer's orders."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    sign = F.when(customer % 4 == 0, "화").when(customer % 4 == 1, " 話").when(customer % 4 == 2, "회").otherwise("편")
    label = F.concat("o_orderpriority", F.lit(" "), (key % 5).cast("string"), F.lit("회차 "), (key % 97).cast("string"), sign, F.when(key % 3 == 0, " 2회차").otherwise(""))
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", titles.episode_number(label).alias("number"))
    following = F.lead("number").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return rows.select("o_orderkey", "number", titles.episode_gap(F.col("number"), following).alias("gap"))


@query("d19_header_fields", """SELECT doc_id, nullif(trim(lang), '') AS title, nullif(trim(source), '') AS category, CASE WHEN doc_id % 3 > 0 THEN nullif(trim(source), '') END AS author FROM documents""")
def header_fields(spark, sf_dir):
    """Heads made of each document's language and source, read back."""
    told = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.concat(F.lit("# "), told("lang"), F.lit("\n- category: "), told("source"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("\n- author:\t"), told("source"))).otherwise(""), F.lit("\n---\n- author: no\n"), told("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", bodies.header_fields(body).alias("h")).select("doc_id", "h.title", "h.category", "h.author")


@query("d47_size_labels", """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT * (1 + doc_id % 400) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 1048576 THEN format('{:.1f}MB', n / 1048576) WHEN n >= 1024 THEN format('{:,}KB', floor(n / 1024 + 0.5)::BIGINT) ELSE format('{:,}B', n) END AS label FROM d""")
def size_labels(spark, sf_dir):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * (1 + F.col("doc_id") % 400)
    return _t(spark, sf_dir, "documents").select("doc_id", bodies.size_label(size).alias("label"))


@query("d51_clean_names", r"SELECT doc_id, nullif(substr(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g')), 1, 30), '') AS name FROM documents")
def clean_names(spark, sf_dir):
    """The first letters of each text as a name."""
    return _t(spark, sf_dir, "documents").select("doc_id", bodies.clean_name(F.col("text")).alias("name"))


@query("d35_cover_initials", r"SELECT doc_id, coalesce(nullif(upper(substr(regexp_replace(regexp_replace(trim(coalesce(text, '')), '^(?:\s*(?:\[[^\]]*\]|【[^】]*】|\([^)]*\)|〈[^〉]*〉|<[^>]*>))+\s*', ''), '^[\s\p{P}]+', ''), 1, 1)), ''), nullif(upper(substr(trim(coalesce(text, '')), 1, 1)), ''), '?') AS initial FROM documents")
def cover_initials(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", bodies.cover_initial(F.col("text")).alias("initial"))


@query("c12_group_keys", r"SELECT doc_id, CASE WHEN regexp_matches(upper(substr(trim(text), 1, 1)), '^[A-Z]') THEN upper(substr(trim(text), 1, 1)) ELSE '#' END AS letter FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def group_keys(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter("text IS NOT NULL AND trim(text) <> ''").select("doc_id", hangul.group_key(F.col("text")).alias("letter"))


_STATES = "CASE {} WHEN 0 THEN 'complete' WHEN 1 THEN 'review' WHEN 2 THEN 'held' WHEN 3 THEN 'discovered' WHEN 4 THEN 'waiting' WHEN 5 THEN 'unknown' END"


@query("f10_chapter_states", f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_STATES.format('l_partkey % 7')} AS old, {_STATES.format('l_suppkey % 7')} AS new FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN old IS NULL THEN new WHEN new IS NULL THEN old WHEN old = 'complete' THEN old WHEN new = 'discovered' AND old IN ('review', 'held') THEN old WHEN new = 'unknown' AND old = 'waiting' THEN old ELSE new END AS status FROM s""")
def chapter_states(spark, sf_dir):
    names = F.array(*map(F.lit, ("complete", "review", "held", "discovered", "waiting", "unknown")))
    state = lambda c: F.get(names, (F.col(c) % 7).cast("int"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", merge.chapter_status(state("l_partkey"), state("l_suppkey")).alias("status"))


@query("c11_near_words", r"""WITH t AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> ''), d AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM conversations) WHERE w <> '')
SELECT t.w AS typed, d.w AS word, levenshtein(t.w, d.w)::INT AS slips FROM t JOIN d ON abs(length(t.w) - length(d.w)) <= 1 AND levenshtein(t.w, d.w) <= 1""")
def near_words(spark, sf_dir):
    """Words of conversations that are at most a slip from a word of the benchmark."""
    words = lambda name: _t(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter("w <> ''").distinct()
    return suggest.near_words(words("benchmark"), "w", suggest.slip_index(words("conversations"), "w"))


@query("e7_split_groups", """SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 10 > 0 THEN c_custkey ELSE min(CASE WHEN NOT (c_nationkey % 3 = 0 AND c_custkey % 10 > 0) THEN c_custkey END) OVER (PARTITION BY c_custkey // 10) END AS canonical
FROM customer WHERE c_custkey // 10 IN (SELECT c_custkey // 10 FROM customer WHERE c_custkey % 10 = 0) AND c_custkey // 10 IN (SELECT c_custkey // 10 FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def split_groups(spark, sf_dir):
    """Groups of ten customers linked to the first of them, from which those of some nations are taken back."""
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") - F.col("c_custkey") % 10).alias("head"))
    heads = customer.select(F.col("c_custkey").alias("head"))
    links = customer.filter("c_custkey <> head").join(heads, "head").select(F.col("head").alias("a"), F.col("c_custkey").alias("b"), "c_nationkey")
    with temporary(spark):
        labels = works.merge_links(links, "a", "b")
        return materialise(works.split_links(labels, links.select("a", "b"), links.filter("c_nationkey % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")), "a", "b"), "split", keep=True)


@query("a16_captures", """SELECT DISTINCT url, sha256(html) AS raw_sha256, octet_length(encode(html))::BIGINT AS bytes FROM (SELECT regexp_replace(url, '#.*$', '') AS url, html FROM pages WHERE html IS NOT NULL)""")
def stored_captures(spark, sf_dir):
    """Pages, without the fragments of their addresses, written as captures in two batches that overlap and read back."""
    pages = _t(spark, sf_dir, "pages").select(F.regexp_replace("url", "#.*$", "").alias("url"), F.lit(200).alias("status"), F.encode("html", "UTF-8").alias("body"), "page_id")
    with temporary(spark):
        path = own_dir(spark, "captures")
        captures.store_captures(pages.filter("page_id % 3 > 0"), path)
        captures.store_captures(pages, path)
        rows = spark.read.format("captures").option("path", path).load()
        return materialise(rows.select("url", F.sha2("body", 256).alias("raw_sha256"), F.octet_length("body").cast("long").alias("bytes")), "captured", keep=True)
