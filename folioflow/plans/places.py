"""Queries of places in texts, outboxes, collectors, export modes and reviewed links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.functions import places
from folioflow.operators import queue, release, search, works


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("c14_search_copies", """SELECT o_orderkey, ' k' || o_orderkey || ' i' || chr(775) AS copy, 3 AS start, 3 + length(o_orderkey::VARCHAR)::INT AS stop, 6 + length(o_orderkey::VARCHAR)::INT AS last FROM orders""")
def search_copies(spark, sf_dir):
    """Order keys among wide letters and repeated spaces, found in the copy and brought back to the text."""
    key = F.col("o_orderkey").cast("string")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), places.search_copy(F.concat(F.lit("  Ｋ"), key, F.lit("\t\nİ"))).alias("c"))
    hit, whole = places.source_range(F.col("c"), F.lit(2), F.length("key") + 2), places.source_range(F.col("c"), F.lit(0), F.length("c.text"))
    return rows.select("o_orderkey", F.col("c.text").alias("copy"), hit["start"].alias("start"), hit["stop"].alias("stop"), whole["stop"].alias("last"))


@query("c16_locators", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'candidate' END AS status, (CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END + 23 + length(o_orderkey::VARCHAR))::INT AS start FROM orders""")
def locators(spark, sf_dir):
    """The second of two equal words, found again in a text that got a new beginning, by the letters around it."""
    line = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" a word. And the word too."))
    place = places.locator(line, F.length(line) - 9, F.length(line) - 5, F.lit("r1"))
    even = F.col("o_orderkey") % 2 == 0
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"), F.concat(F.when(even, "").otherwise("New. "), line).alias("text"), F.when(even, "r1").otherwise("r2").alias("rev"))
    found = rows.select("o_orderkey", places.resolved_locator("text", "rev", "place").alias("f"))
    return found.select("o_orderkey", "f.status", "f.start")


@query("d40_quotes", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Two ' ELSE '' END || o_orderkey || ' three. Four' AS quote FROM orders")
def quotes(spark, sf_dir):
    place = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "One!”  Two ").otherwise("no end ").alias("prefix"), F.col("o_orderkey").cast("string").alias("exact"), F.lit("\n three.  Four").alias("suffix"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", places.last_quote(place).alias("quote"))


@query("c27_trigram_index", """WITH t AS (SELECT page_id, unnest([substr(url, i, 3) FOR i IN range(1, greatest(length(url) - 1, 2))]) AS term FROM pages)
SELECT term, count(DISTINCT page_id) AS documents, count(*) AS places, strlen(term)::BIGINT AS bytes FROM t WHERE term <> '' GROUP BY term""")
def trigram_index(spark, sf_dir):
    return search.term_index(_t(spark, sf_dir, "pages"), "page_id", F.col("url"), trigrams=True)


@query("h7_export_modes", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'source_changed' WHEN 2 THEN 'source_rewound' WHEN 3 THEN 'collections' WHEN 4 THEN 'projection_untracked' WHEN 5 THEN 'delta_too_large' WHEN 6 THEN 'delta' WHEN 7 THEN 'delta' ELSE 'noop' END AS mode FROM orders""")
def export_modes(spark, sf_dir):
    form = F.col("o_orderkey") % 8
    base = {name: F.lit(1) for name in ("source", "water", "projection", "posts", "content", "collections")}
    other = lambda *forms: F.when(form.isin(*forms), 0).otherwise(1)
    now = {"source": other(1), "water": other(2), "projection": other(4, 5, 6, 7), "posts": other(7), "content": other(4, 5, 6, 7), "collections": other(3)}
    changed = F.when(form == 5, 5001).when(form == 6, 5000).otherwise(0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", release.incremental_mode(base, now, changed).alias("mode"))


@query("h16_unchanged_lanes", "SELECT l_shipdate::DATE AS day, count(*) FILTER (l_orderkey % 500 = 0) = 0 AS unchanged FROM lineitem GROUP BY 1")
def unchanged_lanes(spark, sf_dir):
    """Days of shipping as lanes; the quantity of some orders has changed since."""
    before = _t(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_quantity")
    after = before.withColumn("l_quantity", F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return release.unchanged_lanes(before, after, "day", "l_orderkey", "l_linenumber", "l_quantity")


@query("g15_enqueued", """WITH a AS (SELECT event_id, CASE WHEN event_type = 'view' THEN user_id END AS k, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS n FROM events)
SELECT event_id FROM (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS m FROM a WHERE n = 1) WHERE k IS NULL OR m = 1""")
def enqueued(spark, sf_dir):
    """Every request comes up to three times; views are a user's status, of which the last one counts."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.expr("event_id div 3").alias("request"), F.when(F.col("event_type") == "view", F.col("user_id")).alias("status_of"))
    return queue.enqueued(rows, "event_id", "request", "status_of").select("event_id")


_OUTBOX = """WITH o AS (SELECT user_id, event_id, 1 + event_id % 900 AS size, CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 90 WHEN 'click' THEN 50 ELSE 10 END AS priority FROM events)"""


@query("g15_evicted", _OUTBOX + """, c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY priority, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER (PARTITION BY user_id) AS free FROM o WHERE priority <= 50)
SELECT event_id FROM c WHERE freed < 4000 AND free >= 4000""")
def evicted(spark, sf_dir):
    priority = F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "error", 90).when(F.col("event_type") == "click", 50).otherwise(10)
    outbox = _t(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), "event_id", (1 + F.col("event_id") % 900).alias("size"), priority.alias("rank"))
    room = outbox.select("lane").distinct().select("lane", F.lit(4000).alias("needed"), F.lit(50).alias("priority"))
    return queue.evicted(outbox, room, "event_id", "size", "rank").select("event_id")


@query("g15_head_of_line", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 480000), 1000000000)")
def head_of_line(spark, sf_dir):
    """Prices stand for the times at which rows are due."""
    return queue.head_of_line(_t(spark, sf_dir, "orders"), F.lit(480_000), "o_orderkey", "o_totalprice").select("o_orderkey")


@query("g20_next_unit", """SELECT 'b' AS source, 'episode' AS kind, o_orderkey::VARCHAR AS entity FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 2 = 0 AND o_orderstatus <> 'P' ORDER BY o_orderdate, entity LIMIT 1""")
def next_unit(spark, sf_dir):
    """The third of four requests takes an episode, of the source that bodies come from."""
    rows = _t(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "episode").otherwise("work").alias("kind"), F.col("o_orderkey").cast("string").alias("entity"),
        F.when(F.col("o_orderstatus") == "P", "done").otherwise("pending").alias("status"), F.lit(0).alias("next_check_at"), F.col("o_orderdate").alias("updated_at"),
    )
    lists = rows.select("source").distinct().select("source", F.lit(3).alias("next_page"), F.lit(0).alias("next_check_at"))
    return queue.next_unit(rows, lists, lists.select("source", F.lit(-1).alias("cooldown_until")), F.lit(0), 6, "a", "b")


@query("e7_reviewed_links", """SELECT o_custkey, o_orderkey + 1000000 AS o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0""")
def reviewed_links(spark, sf_dir):
    """Even orders are certain links; every third one was rejected, and the even ones of them accepted after that, named the other way round."""
    rows = _t(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") + 1_000_000).alias("o_orderkey"), F.col("o_orderkey").alias("k"))
    reject = rows.filter("k % 3 = 0").select("o_custkey", "o_orderkey", F.lit(1).alias("n"), F.lit("reject").alias("decision"))
    accept = rows.filter("k % 6 = 0").select(F.col("o_orderkey").alias("o_custkey"), F.col("o_custkey").alias("o_orderkey"), F.lit(2).alias("n"), F.lit("accept").alias("decision"))
    return works.reviewed_links(rows.withColumn("certain", F.col("k") % 2 == 0), reject.unionByName(accept), "o_custkey", "o_orderkey", "n")
