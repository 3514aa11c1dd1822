"""Reading statistics and synchronisation queries over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.operators import reading, sync


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark, sf_dir):
    """Order lines as entries of a work: what was returned has been read to the end, low quantities are unread."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("position")).agg(F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("at"))
    opened = F.col("q") >= 10
    return lines.select("work", "position", "q", F.when(opened, F.col("q") / 50).alias("progress"), F.when(opened, F.col("at")).alias("read_at"))


_ENTRIES = """WITH l AS (SELECT l_orderkey AS work, l_partkey AS position, max(l_quantity) AS q, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2),
e AS (SELECT work, position, q, CASE WHEN q >= 10 THEN q / 50 END AS progress, CASE WHEN q >= 10 THEN shipped END AS read_at FROM l)"""


@query("j5_current_streak", """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS k FROM d),
s AS (SELECT user_id, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, k)
SELECT user_id, coalesce(max(days) FILTER (last_day BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'), 0)::BIGINT AS streak FROM s GROUP BY user_id""")
def current_streak(spark, sf_dir):
    days = reading.day_streaks(_t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")
    return reading.current_streak(days, ["user_id"], F.lit("2024-01-30").cast("date"))


@query("j6_heat_levels", """WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) * 20 AS s FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN s < 60 THEN 0 WHEN s < 600 THEN 1 WHEN s < 1800 THEN 2 WHEN s < 3600 THEN 3 ELSE 4 END AS level FROM d""")
def heat_levels(spark, sf_dir):
    """The value of an event stands for a third of a minute."""
    daily = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((reading.decimal_sum(F.col("value")) * 20).alias("s"))
    return daily.select("user_id", "day", reading.heat_level(F.col("s")).alias("level"))


@query("j8_week_summary", """SELECT user_id, date_trunc('week', ts)::DATE AS week, count(DISTINCT ts::DATE) AS active_days, count(*) AS n FROM events GROUP BY ALL""")
def week_summary(spark, sf_dir):
    daily = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy("user_id", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.count("*").alias("active_days"), F.sum("n").alias("n"))


@query("j9_finished_works", _ENTRIES + """SELECT count(*) FILTER (done = n) AS finished_works, count(*) AS works, sum(done)::BIGINT AS finished_entries
FROM (SELECT work, count(*) FILTER (progress >= 0.95) AS done, count(*) AS n FROM e GROUP BY work)""")
def finished_works(spark, sf_dir):
    works = _entries(spark, sf_dir).groupBy("work").agg(F.count_if(F.col("progress") >= 0.95).alias("done"), F.count("*").alias("n"))
    return works.agg(F.count_if(F.col("done") == F.col("n")).alias("finished_works"), F.count("*").alias("works"), F.sum("done").alias("finished_entries"))


@query("j11_occupancy", _ENTRIES + """SELECT work, CASE WHEN done >= available THEN 'finished' WHEN seen > 0 THEN 'reading' ELSE 'unread' END AS state, available, greatest(0, available - seen) AS fresh
FROM (SELECT work, count(progress) AS seen, count(*) FILTER (progress >= 0.95) AS done, count(*) AS available FROM e GROUP BY work)""")
def occupancy(spark, sf_dir):
    works = _entries(spark, sf_dir).groupBy("work").agg(F.count("progress").alias("seen"), F.count_if(F.col("progress") >= 0.95).alias("done"), F.count("*").alias("available"))
    return works.select("work", reading.occupancy(F.col("seen"), F.col("done"), F.col("available")).alias("state"), "available", F.greatest(F.lit(0), F.col("available") - F.col("seen")).alias("fresh"))


@query("j12_continue_target", _ENTRIES + """, m AS (SELECT *, coalesce(progress >= 0.95, false) AS fin FROM e),
a AS (SELECT work, arg_max(position, (read_at, position)) FILTER (read_at IS NOT NULL) AS last, arg_max(fin, (read_at, position)) FILTER (read_at IS NOT NULL) AS done, min(position) AS first FROM m GROUP BY work),
n AS (SELECT a.work, any_value(last) AS last, any_value(done) AS done, any_value(first) AS first, min(position) FILTER (NOT fin AND position > last) AS next FROM a JOIN m ON a.work = m.work GROUP BY a.work)
SELECT work, CASE WHEN last IS NULL THEN 'start' WHEN NOT done THEN 'resume' WHEN next IS NOT NULL THEN 'next' ELSE 'finished' END AS action,
CASE WHEN last IS NULL THEN first WHEN NOT done THEN last ELSE next END AS target FROM n""")
def continue_target(spark, sf_dir):
    return reading.continue_target(_entries(spark, sf_dir), "work", "position", "progress", "read_at")


@query("j14_weighted_sample")
def weighted_sample(spark, sf_dir):
    """A seeded sample of 20 documents by length; the hash has no SQL counterpart, tests compare with a plain form."""
    return reading.weighted_sample(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.log10(1.0 + F.col("n_chars")), seed=7, size=20)


@query("j16_equal_bins", _ENTRIES + """, r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY position) - 1 AS n, count(*) OVER (PARTITION BY work) AS c FROM e),
b AS (SELECT work, b AS bin, c FROM r, (VALUES (0), (1), (2)) v(b) WHERE n = 0 AND b < least(3, c))
SELECT work, bin::BIGINT AS bin, count(*) AS n, max(CASE WHEN progress >= 0.95 THEN 2 WHEN progress IS NOT NULL THEN 1 ELSE 0 END) AS state_rank
FROM r JOIN (SELECT work, bin, (bin * c) // least(3, c) AS lo, ((bin + 1) * c) // least(3, c) AS hi FROM b) k USING (work) WHERE n >= lo AND n < hi GROUP BY work, bin""")
def equal_bins(spark, sf_dir):
    state = F.when(F.col("progress") >= 0.95, 2).when(F.col("progress").isNotNull(), 1).otherwise(0)
    return reading.equal_bins(_entries(spark, sf_dir), "work", "position", state, 3)


@query("j19_next_available", _ENTRIES + """, r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY position) AS n FROM e),
x AS (SELECT work, position, n, min(CASE WHEN q > 25 THEN n END) OVER (PARTITION BY work ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM r)
SELECT x.work, x.position, r.position AS next_position, m - x.n - 1 AS skipped FROM x LEFT JOIN r ON x.work = r.work AND m = r.n""")
def next_available(spark, sf_dir):
    return reading.next_available(_entries(spark, sf_dir), "work", "position", F.col("q") > 25).select("work", "position", "next_position", "skipped")


@query("j20_compact_history", """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE a <= 10 OR b = 1""")
def compact_history(spark, sf_dir):
    return reading.compact_history(_t(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 10).select("event_id")


@query("j24_last_before", """SELECT event_id, (SELECT arg_max(p.value, p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id) AS price FROM events e WHERE event_type = 'error'""")
def last_before(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    marks = events.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("value").alias("price"))
    return reading.last_before(events.filter("event_type = 'error'").select("user_id", "event_id"), marks, ["user_id"], "event_id", "price").select("event_id", "price")


@query("k1_resolve", """SELECT user_id, ts::DATE AS day, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts, max(value) AS value,
bool_or(event_type = 'error' AND user_id < 50) OR arg_max(event_type, (ts, event_type)) = 'error' AS deleted FROM events GROUP BY ALL""")
def resolve(spark, sf_dir):
    """Errors delete; for users under 50 a deletion is final."""
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return sync.resolve(events, ["user_id", "day"], "ts", "event_type", "value", F.col("event_type") == "error", F.col("user_id") < 50)


@query("k2_number_changes", """WITH f AS (SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT + 100 AS revision FROM f""")
def number_changes(spark, sf_dir):
    return sync.number_changes(_t(spark, sf_dir, "events"), "user_id", "props", "event_id", 100).select("user_id", "event_id", "revision")


@query("k3_pull", """WITH r AS (SELECT user_id, event_id AS revision, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_id > 500)
SELECT user_id, revision, c > 5 AS more FROM r WHERE n <= 5""")
def pull(spark, sf_dir):
    return sync.pull(_t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision")), "user_id", 500, 5)


@query("k13_compact_outbox", """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, value > 10 ORDER BY event_id DESC) AS n FROM events) WHERE value > 10 OR n = 1""")
def compact_outbox(spark, sf_dir):
    return sync.compact_outbox(_t(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value") > 10, "event_id").select("event_id")
