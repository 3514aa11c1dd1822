"""Auditable work queue: claims, ranking, terminal states, sweeps and retention.

A queue is a table; every step is a function of the table and of ``now``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retry_delay(attempts: Column, base: int = 120, cap: int = 21600) -> Column:
    """Seconds until the next attempt: doubled after each failure, up to ``cap``."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(40)) - 1)).cast("long")


def failed_state(attempts: Column, code: Column, capped: list[str], network: list[str], capped_limit: int = 5, network_limit: int = 24) -> Column:
    """retry, or dead once a code of a limited kind has used up its attempts; other codes are retried for ever."""
    worn = (code.isin(capped) & (attempts >= capped_limit)) | (code.isin(network) & (attempts >= network_limit))
    return F.when(F.coalesce(worn, F.lit(False)), "dead").otherwise("retry")


def return_expired(queue: DataFrame, now: Column) -> DataFrame:
    """Running rows whose lease has ended wait for a retry again."""
    expired = (F.col("state") == "running") & (F.col("lease_expires_at") <= now)
    return queue.withColumns({
        "state": F.when(expired, "retry").otherwise(F.col("state")),
        "lease_expires_at": F.when(expired, F.lit(None)).otherwise(F.col("lease_expires_at")),
    })


def claim(queue: DataFrame, now: Column, size: int) -> DataFrame:
    """The next due rows by priority, board and id, with one attempt more."""
    due = return_expired(queue, now).filter(F.col("state").isin("pending", "retry") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return due.orderBy(F.desc("priority"), "board", "id").limit(size).withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1})


def recovery_order(queue: DataFrame, size: int, missing_only: bool = False) -> DataFrame:
    """The next rows to recover, taking turns between boards; rows without a body come first.

    Needs board, id, has_body, state, priority, attempts and board_group (an integer rank).
    A row behind ``size`` others of its own board cannot be among the first ``size``, so
    each task keeps only that many per board before the shuffle.
    """
    first = "pending" if missing_only else "retry"
    rows = queue.filter(F.col("state").isin("pending", "retry"))
    if missing_only:
        rows = rows.filter(~F.col("has_body"))
    rows = rows.withColumns({"body_rank": F.col("has_body").cast("int"), "state_rank": F.when(F.col("state") == first, 0).otherwise(1)})
    inside = Window.partitionBy("board").orderBy("body_rank", "state_rank", F.desc("priority"), "attempts", "id")
    rows = rows.withColumn("board_rank", F.row_number().over(inside)).filter(F.col("board_rank") <= size)
    return rows.orderBy("body_rank", "board_rank", "state_rank", "board_group", F.desc("priority"), "attempts", "board", "id").limit(size)


def sweep(stored: DataFrame, reported: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action) after a full report: insert, update, keep, or delete what was not reported.

    Fields are compared with nulls equal to nulls, so unchanged rows need no rewrite.
    """
    old = stored.select(key, F.struct(*fields).alias("_old"))
    new = reported.select(key, F.struct(*fields).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return old.join(new, key, "full").select(key, action.alias("action"))


def expired_runs(runs: DataFrame, now: Column, at: str, failed: Column, keep_fine_days: int = 30, keep_failed_days: int = 90) -> DataFrame:
    """Runs past their retention; failed ones are kept longer."""
    age = F.when(failed, keep_failed_days).otherwise(keep_fine_days)
    return runs.filter(F.col(at) < F.timestamp_add("DAY", -age, now))


def over_budget(files: DataFrame, keys: list[str], at: str, size: str, budget: int, *ties: str) -> DataFrame:
    """Files to delete so that the newest files of each key stay within ``budget`` bytes."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(at), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("kept_bytes", F.sum(size).over(newest)).filter(F.col("kept_bytes") > budget)


def pruned_files(files: DataFrame, keys: list[str], at: str, size: str, ident: str, now: Column, keep_seconds: int, budget: int, least_seconds: int = 0) -> DataFrame:
    """Files to delete: older than ``keep_seconds``, and then the oldest until the rest of each key is within ``budget`` bytes.

    Files younger than ``least_seconds`` stay in any case. What a file leaves is the sum of it
    and all newer ones, so one running sum from the newest tells both.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(size), F.desc(ident)).rowsBetween(Window.unboundedPreceding, 0)
    age = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = files.withColumns({"kept_bytes": F.sum(size).over(newest), "_age": age})
    return rows.filter((F.col("_age") >= least_seconds) & ((F.col("_age") > keep_seconds) | (F.col("kept_bytes") > budget))).drop("_age")


def boundary_page(listing: DataFrame, anchors: DataFrame, board: str, page: str, place: str, ident: str, unchanged: Column, overlap: int = 2, run: int = 20) -> DataFrame:
    """board and last_page: the page at which each board's incremental pass ends.

    With an anchor (the newest post of the pass before) that is the page of the first row at or
    below it, without one that of the row at which ``run`` rows in a row are unchanged; then
    ``overlap`` pages follow. Boards that reach neither are left out.
    """
    rows = listing.join(anchors.select(board, F.col("anchor").alias("_anchor")), board, "left")
    order = Window.partitionBy(board).orderBy(page, place)
    last_change = F.max(F.when(~unchanged, F.col("_row"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_row", F.row_number().over(order)).withColumn("_quiet", F.col("_row") - F.coalesce(last_change, F.lit(0)))
    ends = F.when(F.col("_anchor").isNotNull(), F.col(ident) <= F.col("_anchor")).otherwise(F.col("_quiet") >= run)
    return rows.filter(ends).groupBy(board).agg((F.min(page) + overlap).alias("last_page"))


def first_boundary(listing: DataFrame, board: str, position: str, unchanged: Column, run: int = 20) -> DataFrame:
    """The position at which each board's listing has been unchanged ``run`` times in a row (boards without one are left out)."""
    order = Window.partitionBy(board).orderBy(position)
    last_change = F.max(F.when(~unchanged, F.col("_row"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = listing.withColumn("_row", F.row_number().over(order)).withColumn("_quiet", F.col("_row") - F.coalesce(last_change, F.lit(0)))
    return rows.filter(F.col("_quiet") == run).groupBy(board).agg(F.min(position).alias("boundary"))


def seed(queue: DataFrame, listed: DataFrame, keys: list[str], capped: list[str]) -> DataFrame:
    """The queue after a listing: new rows are pending, or done if their body is captured; others are refreshed.

    A done row opens again if the listing asks for it (reopen_done), a dead one if its code
    is one of ``capped`` and the listing's fingerprint differs from the known one. Opened
    rows begin with no attempts. Needs state, attempts, next_attempt_at, last_error_code,
    priority, listing_sha in ``queue``; listed rows have priority, listing_sha, captured, reopen_done.
    """
    new = listed.select(*keys, F.col("priority").alias("_priority"), F.col("listing_sha").alias("_sha"), F.col("captured").alias("_captured"), F.col("reopen_done").alias("_reopen"))
    rows = queue.join(new, keys, "full")
    changed = F.col("listing_sha").isNotNull() & F.coalesce(F.col("_sha") != F.col("listing_sha"), F.lit(False))
    again = F.coalesce((F.col("_reopen") & (F.col("state") == "done")) | ((F.col("state") == "dead") & F.col("last_error_code").isin(capped) & changed), F.lit(False))
    first = F.col("state").isNull()
    return rows.select(
        *keys,
        F.when(first, F.when(F.col("_captured"), "done").otherwise("pending")).when(again, "pending").otherwise(F.col("state")).alias("state"),
        F.when(first | again, 0).otherwise(F.col("attempts")).alias("attempts"), F.when(~again, F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(~again, F.col("last_error_code")).alias("last_error_code"), F.coalesce("_priority", "priority").alias("priority"), F.coalesce("_sha", "listing_sha").alias("listing_sha"),
    )


def unchanged(post: dict[str, Column], listed: dict[str, Column], now: Column, locked_days: int = 30) -> Column:
    """Whether a listed post needs no visit: it has a body and the same fingerprint, or without one the same title, category and count.

    A post without a body is never unchanged, unless it is locked and was tried within ``locked_days``.
    A category that is null on either side is not compared.
    """
    fields = (post["title"] == listed["title"]) & F.coalesce(post["category"] == listed["category"], F.lit(True)) & (post["count"] == listed["count"])
    same = F.when(post["listing_sha"].isNotNull(), post["listing_sha"] == listed["listing_sha"]).otherwise(fields)
    locked = (post["availability"] == "restricted") & (post["last_attempt_at"] > F.timestamp_add("DAY", F.lit(-locked_days), now))
    return F.coalesce(F.when(post["has_body"], same).otherwise(locked), F.lit(False))


def due(queue: DataFrame, now: Column) -> DataFrame:
    """Pending and retrying rows of which the time has come."""
    return queue.filter(F.col("state").isin("pending", "retry") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def requeue(queue: DataFrame, chosen: Column) -> DataFrame:
    """The chosen rows, unless running, are pending again with no attempts and no error."""
    again = F.coalesce(chosen, F.lit(False)) & (F.col("state") != "running")
    fresh = {"state": F.when(again, "pending").otherwise(F.col("state")), "attempts": F.when(again, 0).otherwise(F.col("attempts")), "last_error_code": F.when(~again, F.col("last_error_code"))}
    return queue.withColumns(fresh)


def revive_missing(queue: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Dead rows of which no body is stored."""
    return queue.filter("state = 'dead'").join(bodies.select(*keys), keys, "left_anti")


def finish(queue: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reported states take effect where the report's lease token is the row's; column fenced tells of reports that came too late.

    ``reports`` has one row per key: lease_token and state (done, retry or dead).
    """
    given = reports.select(*keys, F.col("lease_token").alias("_token"), F.col("state").alias("_state"))
    rows = queue.join(given, keys, "left")
    fits = F.coalesce((F.col("state") == "running") & (F.col("lease_token") == F.col("_token")), F.lit(False))
    rows = rows.withColumn("fenced", F.col("_token").isNotNull() & ~fits)
    return rows.withColumns({"state": F.when(fits, F.col("_state")).otherwise(F.col("state")), "lease_token": F.when(~fits, F.col("lease_token"))}).drop("_token", "_state")


def stale_runs(runs: DataFrame, events: DataFrame, run: str, at: str, before: Column) -> DataFrame:
    """Running runs that began before ``before`` and have had no event since: they can be interrupted."""
    live = events.filter(F.col(at) >= before).select(run).distinct()
    return runs.filter((F.col("state") == "running") & (F.col("started_at") < before)).join(live, run, "left_anti")


def fill_window(queue: DataFrame, candidates: DataFrame, keys: list[str], size: int, order: list[Column]) -> DataFrame:
    """Candidates that are not queued, as many as the window of ``size`` open rows has room for."""
    room = max(0, size - queue.filter(F.col("state").isin("pending", "retry", "running")).count())
    return candidates.join(queue.select(*keys), keys, "left_anti").orderBy(*order).limit(room)


def reserved_batch(due_rows: DataFrame, revisits: DataFrame, size: int, order: list[Column], revisit_order: list[Column], reserved: int = 1) -> DataFrame:
    """Due rows, and at least ``reserved`` places for revisits if there are any; revisits fill what is left."""
    again = revisits.orderBy(*revisit_order).limit(size).withColumn("kind", F.lit("revisit"))
    first = due_rows.orderBy(*order).limit(size).withColumn("kind", F.lit("due"))
    n_due, n_again = first.count(), again.count()
    kept = max(min(reserved, n_again), min(n_again, size - n_due))
    return first.orderBy(*order).limit(size - kept).unionByName(again.orderBy(*revisit_order).limit(kept))


def import_delay(attempts: Column, ladder: tuple[int, ...] = (60, 300, 1800, 7200)) -> Column:
    """Seconds until an import is tried again: a step of the ladder per attempt, the last one from then on."""
    return F.element_at(F.array(*map(F.lit, ladder)), F.greatest(F.lit(1), F.least(attempts.cast("int"), F.lit(len(ladder)))))


def failure_kind(code: Column, review: list[str], conflict: list[str], gone: list[str]) -> Column:
    """review, conflict and gone for their codes, retry for all others."""
    return F.when(code.isin(review), "review").when(code.isin(conflict), "conflict").when(code.isin(gone), "gone").otherwise("retry")


def next_thread(threads: DataFrame, now: Column, size: int = 1) -> DataFrame:
    """Active threads whose time has come, the newest update first."""
    return threads.filter((F.col("status") == "active") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now))).orderBy(F.desc("updated_at"), "thread_id").limit(size)


def sweep_stop(pages: DataFrame, board: str, page: str, oldest: str, newest_before: str) -> DataFrame:
    """Per board the first page whose oldest thread is older than the newest one of the sweep before; null while none is."""
    return pages.groupBy(board).agg(F.min(F.when(F.col(oldest) < F.col(newest_before), F.col(page))).alias("stop_page"))


def claim_one(queue: DataFrame, keys: dict[str, object], now: Column, seconds: int, disabled: DataFrame | None = None) -> DataFrame:
    """The row of the given keys as claimed, or none: it is due, or its lease has ended, and its board isn't disabled.

    The claimed row runs with one attempt more and a lease of ``seconds``.
    """
    chosen = F.lit(True)
    for name, value in keys.items():
        chosen = chosen & (F.col(name) == F.lit(value))
    rows = due(return_expired(queue.filter(chosen), now), now)
    if disabled is not None:
        rows = rows.join(disabled.select("board"), "board", "left_anti").select(*queue.columns)
    return rows.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_expires_at": F.timestamp_add("SECOND", F.lit(seconds), now)})


def requeue_given(queue: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """The queue in which the given rows are pending again, as in ``requeue``."""
    marks = given.select(*keys).distinct().withColumn("_given", F.lit(True))
    return requeue(queue.join(marks, keys, "left"), F.col("_given")).select(*queue.columns)


def enqueued(arrivals: DataFrame, ident: str, once: str, replaces: str) -> DataFrame:
    """An outbox after its arrivals in order of id: a repeated ``once`` key is the first one's, and of those with a ``replaces`` key the last one stays (null: all)."""
    first = arrivals.join(arrivals.groupBy(once).agg(F.min(ident).alias(ident)), [once, ident], "left_semi")
    newest = first.filter(F.col(replaces).isNotNull()).groupBy(replaces).agg(F.max(ident).alias(ident))
    return first.join(newest, [replaces, ident], "left_semi").unionByName(first.filter(F.col(replaces).isNull()))


def evicted(outbox: DataFrame, room: DataFrame, ident: str, size: str, priority: str, protected: int = 100) -> DataFrame:
    """The rows of each outbox (``lane``) that go so that ``room.needed`` bytes become free for an item of ``room.priority``.

    The least priority goes first, then the oldest; rows of ``protected`` priority or of more than
    the item's stay. A lane that can't make room loses nothing (``room`` of such lanes is refused).
    """
    rows = outbox.join(room.select("lane", "needed", F.col("priority").alias("_most")), "lane").filter((F.col(priority) < protected) & (F.col(priority) <= F.col("_most")))
    before = Window.partitionBy("lane").orderBy(priority, ident).rowsBetween(Window.unboundedPreceding, -1)
    free = rows.groupBy("lane").agg(F.sum(size).alias("_free"))
    rows = rows.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).join(free, "lane")
    return rows.filter((F.col("_free") >= F.col("needed")) & (F.col("_before") < F.col("needed"))).drop("needed", "_most", "_before", "_free")


def head_of_line(outbox: DataFrame, now: Column, ident: str, due_at: str, size: int = 50) -> DataFrame:
    """The first ``size`` rows by id, up to the first one that isn't due yet: none overtakes another."""
    first = outbox.filter(F.col(due_at) > now).agg(F.min(ident).alias("_stop"))
    head = outbox.orderBy(ident).limit(size)
    return head.join(F.broadcast(first), F.col("_stop").isNull() | (F.col(ident) < F.col("_stop"))).drop("_stop")  # one row


def next_unit(queue: DataFrame, lists: DataFrame, cooling: DataFrame, now: Column, served: int, last_source: str | None, body_source: str | None) -> DataFrame:
    """The next request of a collector: source, kind and entity, at most one row.

    Of four requests two prefer listings, one episodes and one works; then the other source than
    the last one's goes first. ``queue`` has source, kind, entity, status, next_check_at and
    updated_at, ``lists`` source, next_page and next_check_at, ``cooling`` source and cooldown_until.
    """
    slot = served % 4
    preferred = "list" if slot < 2 else "episode" if slot == 2 and body_source else "work"
    fallback = "episode" if body_source and slot in (0, 2) else "work"
    rank = F.when(F.col("kind") == preferred, 0).when(F.col("kind") == fallback, 1).otherwise(2)
    bodies = F.col("source") == body_source if body_source not in (None, "both") else F.lit(body_source == "both")
    waiting = queue.filter(F.col("status").isin("pending", "retry", "review", "gone") & (F.col("next_check_at") <= now) & ((F.col("kind") != "episode") | bodies))
    first = waiting.groupBy("source").agg(F.min(F.struct(rank.alias("rank"), "updated_at", "kind", "entity")).alias("u")).select("source", "u.kind", "u.entity", "u.rank")
    pages = lists.filter(F.col("next_check_at") <= now).select("source", F.lit("list").alias("kind"), F.col("next_page").cast("string").alias("entity"), F.lit(0 if preferred == "list" else 1).alias("rank"))
    found = first.unionByName(pages).join(cooling.filter(F.col("cooldown_until") > now).select("source"), "source", "left_anti")
    return found.orderBy("rank", F.col("source").eqNullSafe(F.lit(last_source)), "source", "kind").limit(1).select("source", "kind", "entity")
