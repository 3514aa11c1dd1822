"""Queries of decisions that follow one another: pages, ledgers, commands and leases, in tables and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.catalogue import query
from folioflow.operators import commands, paging
from folioflow.sources import releases
from folioflow.streaming import jobs, runs, stateful

HOUR = 3_600_000_000


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("h15_availability_pages", """WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(octet_length(encode(text)), 0) AS n, row_number() OVER w - 1 AS i, sum(coalesce(octet_length(encode(text)), 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
e AS (SELECT source, c, min(i) AS i FROM d GROUP BY 1, 2),
f AS (SELECT d.source, d.i, min(e.i) AS j FROM d JOIN e ON d.source = e.source AND d.c - d.n + 1048576 < e.c GROUP BY 1, 2),
nxt AS (SELECT source, d.i, greatest(d.i + 1, least(d.i + 500, coalesce(e.j, d.i + 500))) AS j FROM d LEFT JOIN f AS e USING (source, i)),
p AS (SELECT source, 0::BIGINT AS page, 0::BIGINT AS i FROM d GROUP BY source UNION ALL SELECT p.source, page + 1, nxt.j FROM p JOIN nxt ON nxt.source = p.source AND nxt.i = p.i),
s AS (SELECT p.* FROM p JOIN d USING (source, i)),
z AS (SELECT d.source, doc_id, d.i, s.i AS si, max(s.page) OVER w AS page, max(s.i) OVER w AS start FROM d LEFT JOIN s USING (source, i) WINDOW w AS (PARTITION BY d.source ORDER BY d.i ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, page, i - start AS slot FROM z""")
def availability_pages(spark, sf_dir):
    """Documents of each source in pages of 500 or 1 MiB of text."""
    return paging.pages(_t(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("n")), "source", "doc_id", "n")


@query("h11_ledger_states", """WITH r AS (SELECT user_id, event_id AS n, CASE event_type WHEN 'view' THEN 'intent' WHEN 'purchase' THEN 'intent' WHEN 'error' THEN 'dropped' ELSE 'done' END AS step, 'r' || event_id AS release FROM events),
w AS (SELECT *, lag(step) OVER o AS last, lag(release) OVER o AS intended, lead(step) OVER o AS following FROM r WINDOW o AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, max_by(intended, n) FILTER (step = 'done' AND last = 'intent') AS active, max(n) FILTER (step = 'done' AND last = 'intent') AS activated_at, max(release) FILTER (step = 'intent' AND following IS NULL) AS pending,
count(*) FILTER (step = 'done' AND last = 'intent') AS activations, count(*) FILTER (step = 'dropped' AND last = 'intent') AS dropped, count(*) FILTER (step <> 'intent' AND last IS DISTINCT FROM 'intent') AS faults FROM w GROUP BY user_id""")
def ledger_states(spark, sf_dir):
    """The active release of each user's ledger of activations."""
    step = F.when(F.col("event_type").isin("view", "purchase"), releases.INTENT).when(F.col("event_type") == "error", releases.DROPPED).otherwise(releases.DONE)
    return releases.ledger_states(_t(spark, sf_dir, "events"), "user_id", "event_id", step, F.concat(F.lit("r"), F.col("event_id").cast("string")))


# One row per event, decided from the state that the event before has left.
_COMMANDS = f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS tm, event_id AS seq,
 CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'cancel' ELSE 'beat' END AS kind, 'k' || (event_id % 9) AS key, 'r' || (event_id % 2) AS runner FROM events),
q AS (
 SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS seq, ''::VARCHAR AS outcome, NULL::BIGINT AS command, 'none'::VARCHAR AS st, NULL::BIGINT AS act, NULL::VARCHAR AS who, 0::BIGINT AS expires, 0::BIGINT AS til, 0::INT AS claims, MAP {{}}::MAP(VARCHAR, BIGINT) AS known FROM e GROUP BY user_id
 UNION ALL
 SELECT user_id, n, seq, outcome, CASE WHEN outcome = 'replayed' THEN known[key] WHEN outcome = 'accepted' THEN seq WHEN outcome IN ('nothing', 'ignored', 'not_finishable', 'not_cancellable') THEN NULL ELSE act END,
  CASE outcome WHEN 'accepted' THEN 'queued' WHEN 'claimed' THEN 'claimed' WHEN 'finished' THEN 'none' WHEN 'cancelled' THEN 'none' ELSE st END,
  CASE WHEN outcome = 'accepted' THEN seq WHEN outcome IN ('finished', 'cancelled') THEN NULL ELSE act END,
  CASE WHEN outcome = 'claimed' THEN runner WHEN st = 'claimed' THEN who END, CASE outcome WHEN 'accepted' THEN tm + {24 * HOUR} ELSE expires END,
  CASE WHEN outcome IN ('claimed', 'renewed') THEN tm + {8 * HOUR} ELSE til END, CASE outcome WHEN 'accepted' THEN 0 WHEN 'claimed' THEN claims + 1 ELSE claims END,
  CASE WHEN outcome = 'accepted' THEN map_concat(known, MAP {{key: seq}}) ELSE known END
 FROM (SELECT *, CASE kind
   WHEN 'create' THEN CASE WHEN known[key] IS NOT NULL THEN 'replayed' WHEN st <> 'none' THEN 'conflict' ELSE 'accepted' END
   WHEN 'claim' THEN CASE WHEN st = 'queued' AND expires > tm THEN 'claimed' ELSE 'nothing' END
   WHEN 'beat' THEN CASE WHEN st = 'claimed' AND who = runner THEN 'renewed' ELSE 'ignored' END
   WHEN 'finish' THEN CASE WHEN st = 'claimed' AND who = runner THEN 'finished' ELSE 'not_finishable' END
   ELSE CASE WHEN st = 'queued' THEN 'cancelled' ELSE 'not_cancellable' END END AS outcome
  FROM (SELECT e.*, q.known, q.who, q.expires, q.til, q.claims,
    CASE WHEN gone THEN NULL ELSE q.act END AS act, CASE WHEN gone THEN 'none' WHEN q.st = 'claimed' AND e.kind = 'claim' AND q.til <= e.tm THEN 'queued' ELSE q.st END AS st
   FROM (SELECT q.*, e.tm AS now, e.kind AS doing, (st = 'queued' AND expires <= e.tm AND NOT (e.kind = 'create' AND known[e.key] IS NOT NULL)) OR (st = 'claimed' AND e.kind = 'claim' AND til <= e.tm AND claims >= 2) AS gone FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1) q
   JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)))
SELECT user_id::VARCHAR AS lane, seq, outcome, command FROM q WHERE n > 0"""


def _command_events(rows):
    kind = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "cancel").otherwise("beat")
    return rows.select(
        F.col("user_id").cast("string").alias("group"), _at().alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("command"),
        F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("runner"),
    )


_RULES = commands.CommandRules(ttl=24 * HOUR, lease=8 * HOUR)


@query("g14_commands", _COMMANDS)
def command_outcomes(spark, sf_dir):
    """A queue of commands for each user: what becomes of every event."""
    return commands.command_outcomes(_command_events(_t(spark, sf_dir, "events")), _RULES).withColumnRenamed("group", "lane")


@query("g14_command_stream", _COMMANDS)
def command_stream(spark, sf_dir):
    """The same, decided by a stream."""
    return runs.run_once(stateful.command_stream(_command_events(runs.read_stream(spark, f"{sf_dir}/events.parquet")), _RULES), "commands").withColumnRenamed("group", "lane")


def _lease_sql(until: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS board, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n, epoch_us(ts) AS tm, CASE WHEN event_type IN ('view', 'click') THEN 'claim' WHEN event_type = 'error' THEN 'release' ELSE 'beat' END AS kind, 'r' || (user_id // 40) AS runner FROM events),
l AS (SELECT board, count(*) AS last FROM e GROUP BY 1),
q AS (
 SELECT board, 0::BIGINT AS n, NULL::VARCHAR AS runner, 0::BIGINT AS since, 0::BIGINT AS til, 0::BIGINT AS beats, 0::BIGINT AS refused, NULL::STRUCT(runner VARCHAR, since BIGINT, "until" BIGINT, beats BIGINT, refused BIGINT, ended VARCHAR) AS gone, NULL::STRUCT(runner VARCHAR, since BIGINT, "until" BIGINT, beats BIGINT, refused BIGINT, ended VARCHAR) AS left_ FROM l
 UNION ALL
 SELECT board, n, CASE WHEN free THEN CASE WHEN kind = 'claim' THEN who END WHEN own AND kind = 'release' THEN NULL ELSE runner END,
  CASE WHEN free THEN tm ELSE since END, CASE WHEN free OR (own AND kind <> 'release') THEN tm + {12 * HOUR} ELSE til END,
  CASE WHEN free THEN 1 WHEN own AND kind <> 'release' THEN beats + 1 ELSE beats END, CASE WHEN free THEN 0 WHEN own THEN refused ELSE refused + 1 END,
  CASE WHEN lapsed THEN {{'runner': runner, 'since': since, 'until': til, 'beats': beats, 'refused': refused, 'ended': 'expired'}} END,
  CASE WHEN NOT free AND own AND kind = 'release' THEN {{'runner': runner, 'since': since, 'until': tm, 'beats': beats, 'refused': refused, 'ended': 'released'}} END
 FROM (SELECT q.board, e.n, e.tm, e.kind, e.runner AS who, q.runner, q.since, q.til, q.beats, q.refused, q.runner IS NULL OR q.til <= e.tm AS free, q.runner IS NOT NULL AND q.til <= e.tm AS lapsed, q.runner = e.runner AS own FROM q JOIN e ON e.board = q.board AND e.n = q.n + 1)),
x AS (SELECT board, gone AS g FROM q UNION ALL SELECT board, left_ FROM q
 UNION ALL SELECT board, {{'runner': runner, 'since': since, 'until': til, 'beats': beats, 'refused': refused, 'ended': 'expired'}} FROM q JOIN l USING (board) WHERE n = last AND runner IS NOT NULL)
SELECT board::VARCHAR AS board, g.runner, g.since, g."until", g.beats, g.refused, g.ended FROM x WHERE g IS NOT NULL{until}"""


def _lease_events(rows):
    kind = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "error", "release").otherwise("beat")
    runner = F.concat(F.lit("r"), F.floor(F.col("user_id") / 40).cast("string"))
    return rows.select((F.col("user_id") % 40).cast("string").alias("board"), _at().alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), runner.alias("runner"), F.col("ts").cast("timestamp").alias("time"))


@query("f17_leases", _lease_sql(""))
def leases(spark, sf_dir):
    """Leases of boards, extended by their holders' beats."""
    return commands.leases(_lease_events(_t(spark, sf_dir, "events")), commands.LeaseRules(12 * HOUR))


@query("f17_lease_stream", _lease_sql(" AND (g.ended = 'released' OR ceil(g.\"until\" / 1000) <= (SELECT epoch_ms(max(ts)) FROM events))"))
def lease_stream(spark, sf_dir):
    """The same by a stream, in which timers end leases; those that are live at the newest event are left out."""
    return runs.run_once(stateful.lease_stream(_lease_events(runs.read_stream(spark, f"{sf_dir}/events.parquet")), commands.LeaseRules(12 * HOUR)), "leases")


def _timed(spark, sf_dir):
    return runs.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("i1_session_stream", """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, count(*) FILTER (before IS NULL OR ts >= before + INTERVAL 2 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e),
x AS (SELECT user_id, session, min(ts) AS started_at, max(ts) + INTERVAL 2 HOUR AS ended_at, count(*) AS inputs FROM s GROUP BY 1, 2) SELECT user_id, started_at, ended_at, inputs FROM x WHERE ended_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def session_stream(spark, sf_dir):
    """Sessions that the watermark has closed."""
    found = runs.run_once(jobs.sessions(_timed(spark, sf_dir), "user_id", "ts", "2 hours", "1 hour"), "sessions")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@query("i2_daily_failure_stream", """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def daily_failure_stream(spark, sf_dir):
    """Days that the watermark has closed."""
    return runs.run_once(jobs.daily_failures(_timed(spark, sf_dir), "ts", "event_type", "1 hour"), "failures").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("i3_first_event_stream", "SELECT DISTINCT user_id, event_type FROM events")
def first_event_stream(spark, sf_dir):
    """The first event of each kind of a user; which it is depends on the order of reading, so only keys are told."""
    return runs.run_once(jobs.first_events(_timed(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days"), "first-events").select("user_id", "event_type")
