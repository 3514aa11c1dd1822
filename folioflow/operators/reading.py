"""Reader analytics: unions of intervals, streaks, progress, samples, bins and history."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    rows = rows.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_span").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_span")


def interval_union(spans: DataFrame, keys: list[str], start: str, stop: str, block: int = 1_000_000) -> DataFrame:
    """Overlapping or touching spans of a key joined into one; empty and reversed spans are left out.

    Spans are first united within blocks of ``block`` start units, so that a key with very
    many spans is spread over tasks and only its united spans meet in one.
    """
    rows = spans.select(*keys, start, stop).filter(F.col(stop) > F.col(start)).withColumn("_block", F.floor(F.col(start) / block))
    return _islands(_islands(rows, [*keys, "_block"], start, stop).drop("_block"), keys, start, stop)


def day_streaks(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days of each key: first day, last day and length."""
    distinct = days.select(*keys, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return distinct.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("_island")


def current_streak(streaks: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """The length of each key's streak that ends today or yesterday; 0 where none does."""
    alive = F.col("last_day").between(F.date_sub(today, 1), today)
    return streaks.groupBy(*keys).agg(F.coalesce(F.max(F.when(alive, F.col("days"))), F.lit(0)).alias("streak"))


def decimal_sum(value: Column) -> Column:
    """The sum of doubles by their decimal digits (nine behind the point), so that the order of addition can't move it over a limit.

    Groups with values that have no such digits (not finite, 10^19 and more) have the sum of doubles.
    """
    digits = value.try_cast("decimal(28,9)")
    return F.when(F.count_if(value.isNotNull() & digits.isNull()) == 0, F.sum(digits).cast("double")).otherwise(F.sum(value))


def heat_level(seconds: Column) -> Column:
    """0 under a minute, then 1 to 4 from 1, 10, 30 and 60 minutes."""
    return F.when(seconds < 60, 0).when(seconds < 600, 1).when(seconds < 1800, 2).when(seconds < 3600, 3).otherwise(4)


def occupancy(read: Column, finished: Column, available: Column) -> Column:
    return F.when(available == 0, "empty").when(finished >= available, "finished").when(read > 0, "reading").otherwise("unread")


def continue_target(entries: DataFrame, work: str, position: str, progress: str, read_at: str, done: float = 0.95) -> DataFrame:
    """(work, action, target): start at the first entry, resume the one read last, go on to the next unfinished, or finished.

    ``progress`` is null for entries that were never opened.
    """
    finished = F.coalesce(F.col(progress) >= done, F.lit(False))
    marked = entries.select(work, position, progress, read_at, finished.alias("_finished"))
    last = marked.groupBy(work).agg(
        F.max_by(position, F.when(F.col(read_at).isNotNull(), F.struct(read_at, position))).alias("_last"),
        F.max_by("_finished", F.when(F.col(read_at).isNotNull(), F.struct(read_at, position))).alias("_done"),
        F.min(position).alias("_first"),
    )
    later = marked.join(last, work).filter(~F.col("_finished") & (F.col(position) > F.col("_last"))).groupBy(work).agg(F.min(position).alias("_next"))
    rows = last.join(later, work, "left")
    action = F.when(F.col("_last").isNull(), "start").when(~F.col("_done"), "resume").when(F.col("_next").isNotNull(), "next").otherwise("finished")
    target = F.when(F.col("_last").isNull(), F.col("_first")).when(~F.col("_done"), F.col("_last")).otherwise(F.col("_next"))
    return rows.select(work, action.alias("action"), target.alias("target"))


def weighted_sample(rows: DataFrame, ident: str, weight: Column, seed: int, size: int) -> DataFrame:
    """``size`` rows without replacement, drawn in proportion to weight; the same seed gives the same rows.

    Each row gets the key ln(u) / weight, with u in (0, 1] from a hash of its id and the seed.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(2**52)) + 1) / F.lit(float(2**52))
    return rows.filter(weight > 0).withColumn("_key", F.log(u) / weight).orderBy(F.desc("_key"), ident).limit(size).drop("_key")


def equal_bins(entries: DataFrame, work: str, position: str, state_rank: Column, bins: int) -> DataFrame:
    """Entries of each work in at most ``bins`` bins of equal count; a bin has its highest state."""
    whole = Window.partitionBy(work)
    rows = entries.withColumns({"_n": F.row_number().over(whole.orderBy(position)) - 1, "_count": F.count("*").over(whole)})
    wide = F.least(F.lit(bins), F.col("_count"))
    # Bin b begins at floor(b * count / bins), so row n stands in bin ceil((n + 1) * bins / count) - 1.
    rows = rows.withColumn("bin", (F.ceil((F.col("_n") + 1) * wide / F.col("_count")) - 1).cast("long"))
    return rows.groupBy(work, "bin").agg(F.count("*").alias("n"), F.max(state_rank).alias("state_rank"))


def length_bins(entries: DataFrame, work: str, position: str, weight: Column, state_rank: Column, bins: int) -> DataFrame:
    """Entries of each work in at most ``bins`` bins of about equal length, each with at least one entry and its highest state.

    Bin b would begin where the running length passes b / bins of the whole; each bin begins at
    least one entry behind the one before and leaves one for every bin after it. That is
    min(max over j <= b of (begin(j) + b - j), count - bins + b), so no fold over entries is
    needed. Weights are whole numbers, at least 1; null counts as 1. Ties in position: any order.
    """
    running = Window.partitionBy(work).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("_weight", F.greatest(F.coalesce(weight.cast("long"), F.lit(1)), F.lit(1)))
    whole = rows.groupBy(work).agg(F.sum("_weight").alias("_total"), F.count("*").alias("_count"))
    rows = rows.withColumns({"_end": F.sum("_weight").over(running), "_n": F.row_number().over(running)}).join(whole, work)
    wide = F.least(F.lit(bins), F.col("_count"))
    rows = rows.withColumns({"_wide": wide, "_passed": F.expr(f"(_end * least({bins}, _count) + _total - 1) div _total")})  # the first bin whose goal the entry doesn't pass
    marks = rows.groupBy(work, "_wide", "_count", "_passed").agg(F.max("_n").alias("_upto"))  # at most one row a bin
    packed = marks.groupBy(work, "_wide", "_count").agg(F.collect_list(F.struct("_passed", "_upto")).alias("_marks"))
    begin = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_wide") - 1), lambda b: F.when(b == 0, 0).otherwise(F.coalesce(F.array_max(F.transform(F.filter("_marks", lambda m: m["_passed"] <= b), lambda m: m["_upto"])), F.lit(0))).cast("long"))
    edge = lambda x, b: F.least(F.array_max(F.transform(F.slice("_begin", 1, (b + 1).cast("int")), lambda y, j: y + b - j)), F.col("_count") - F.col("_wide") + b)
    edges = packed.withColumn("_begin", begin).select(work, F.transform("_begin", edge).alias("_edges"))
    placed = rows.join(edges, work).withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col("_n"))).cast("long") - 1)
    return placed.groupBy(work, "bin").agg(F.count("*").alias("n"), F.sum("_weight").alias("length"), F.max(state_rank).alias("state_rank"))


def next_available(entries: DataFrame, work: str, position: str, available: Column) -> DataFrame:
    """Adds next_position, the next available entry of the work, and skipped, how many stand between."""
    later = Window.partitionBy(work).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy(work).orderBy(position))
    rows = entries.withColumn("_place", place).withColumn("_next", F.min(F.when(available, F.struct("_place", position))).over(later))
    return rows.withColumns({"next_position": F.col(f"_next.{position}"), "skipped": (F.col("_next._place") - F.col("_place") - 1).cast("long")}).drop("_place", "_next")


def compact_history(history: DataFrame, reader: str, work: str, at: str, ident: str, keep: int) -> DataFrame:
    """The ``keep`` newest entries of each reader and the newest of each of their works."""
    newest = [F.desc(at), F.desc(ident)]
    rows = history.withColumns({
        "_overall": F.row_number().over(Window.partitionBy(reader).orderBy(*newest)),
        "_of_work": F.row_number().over(Window.partitionBy(reader, work).orderBy(*newest)),
    })
    return rows.filter((F.col("_overall") <= keep) | (F.col("_of_work") == 1)).drop("_overall", "_of_work")


def last_before(lookups: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each lookup with the value of the last mark of its key at or before it (null: none yet); one sort, no range join."""
    mark = marks.select(*keys, F.col(at), F.lit(0).alias("_kind"), F.struct(value).alias("_mark"))
    rows = lookups.withColumn("_row", F.struct(*lookups.columns)).select(*keys, at, F.lit(1).alias("_kind"), "_row").unionByName(mark, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_mark", F.last("_mark", ignorenulls=True).over(upto)).filter("_kind = 1")
    return found.select("_row.*", F.col(f"_mark.{value}").alias(value))


def activity_spans(beats: DataFrame, keys: list[str], at: str, idle: int) -> DataFrame:
    """(keys, start, stop) of spans of reading: each beat lasts ``idle``, and one within a span extends it."""
    order = Window.partitionBy(*keys).orderBy(at)
    first = F.coalesce(F.col(at) > F.lag(at).over(order) + idle, F.lit(True))
    spans = beats.withColumn("_span", F.sum(first.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*keys, "_span").agg(F.min(at).alias("start"), (F.max(at) + idle).alias("stop")).drop("_span")


def closed_spans(spans: DataFrame, keys: list[str], leaves: DataFrame, at: str) -> DataFrame:
    """Spans cut where the reader left the screen during them; never before their start."""
    cut = spans.join(leaves.select(*keys, F.col(at).alias("_left")), keys, "left").filter("_left IS NULL OR _left < stop")
    ends = cut.filter("_left >= start").groupBy(*keys, "start").agg(F.min("_left").alias("_end"))
    return spans.join(ends, [*keys, "start"], "left").withColumn("stop", F.coalesce("_end", "stop")).drop("_end")


def clipped(stop: Column, now: Column) -> Column:
    """The end of a span that may still be open."""
    return F.least(stop, now)


def month_cells(days: DataFrame, day: str, value: str, first: Column) -> DataFrame:
    """(week, weekday, day, value) of the month of ``first``, weeks from Monday, with 0 for days without a value."""
    month = days.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(first, "month"), F.last_day(first))).alias("day"))
    rows = month.join(days.select(F.col(day).alias("day"), F.col(value).alias("value")), "day", "left")
    pad = F.weekday(F.trunc("day", "month"))
    return rows.select(F.floor((F.dayofmonth("day") - 1 + pad) / 7).cast("int").alias("week"), F.weekday("day").alias("weekday"), "day", F.coalesce("value", F.lit(0)).alias("value"))


def collection_progress(history: DataFrame, members: DataFrame, collection: str, post: str, progress: str, done: float = 0.95) -> DataFrame:
    """(collection, finished, reading, available, occupancy) from a reader's history and the collections' members."""
    last = history.groupBy(post).agg(F.max(progress).alias("_p"))
    per = members.join(last, post, "left").groupBy(collection).agg(F.count_if(F.col("_p") >= done).alias("finished"), F.count_if((F.col("_p") > 0) & (F.col("_p") < done)).alias("reading"), F.count_if("available").alias("available"))
    return per.withColumn("occupancy", occupancy(F.col("finished") + F.col("reading"), F.col("finished"), F.col("available")))


def work_progress(history: DataFrame, work: str, progress: str, read_at: str, total: str, chapters: DataFrame, done: float = 0.95) -> DataFrame:
    """(work, finished, reading, last_read, seen_total, fresh): fresh counts chapters added since the work was last opened."""
    per = history.groupBy(work).agg(F.count_if(F.col(progress) >= done).alias("finished"), F.count_if((F.col(progress) > 0) & (F.col(progress) < done)).alias("reading"), F.max(read_at).alias("last_read"), F.coalesce(F.max(total), F.lit(0)).alias("seen_total"))
    rows = per.join(chapters.select(work, F.col("chapter_count").alias("_now")), work, "left")
    fresh = F.when(F.col("seen_total") > 0, F.greatest(F.col("_now") - F.col("seen_total"), F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("fresh", F.coalesce(fresh, F.lit(0))).drop("_now")


def episode_state(progress: Column, available: Column, fresh: Column, done: float = 0.95) -> Column:
    """missing, read, reading, new or unread."""
    return F.when(~available, "missing").when(progress >= done, "read").when(progress > 0, "reading").when(fresh, "new").otherwise("unread")


def bin_summary(bins: DataFrame, work: str, state: str, states: list[str]) -> DataFrame:
    """How many bins of each state a work has."""
    return bins.groupBy(work).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def trim_to_budget(rows: DataFrame, keys: list[str], at: str, ident: str, size: str, budget: int) -> DataFrame:
    """The newest rows of each key that together stay within ``budget``; all older ones go, even if they would fit."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(ident)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_so_far", F.sum(size).over(newest)).filter(F.col("_so_far") <= budget).drop("_so_far")


def home_works(progress: DataFrame, size: int = 8) -> DataFrame:
    """Works being read for a home page: those with new chapters first, then by the last reading."""
    return progress.filter("reading > 0 OR fresh > 0").orderBy(F.desc(F.col("fresh") > 0), F.desc("last_read"), "work").limit(size)


def pick_of_the_day(day: str, n: int) -> int:
    """A place below ``n`` for a day: a hash of its letters, each times 31 on top of those before, in 32 bits."""
    value = 0
    for letter in day:
        value = (value * 31 + ord(letter)) & 0xFFFFFFFF
    return value % n


def discovery_weight(views: Column) -> Column:
    """The weight of a work in daily picks: 1 + log10(1 + views)."""
    return 1 + F.log10(1 + F.greatest(views, F.lit(0)))


def week_of(daily: DataFrame, keys: list[str], day: str, value: str, today: Column, least: int = 60_000) -> DataFrame:
    """The seven days, from Monday, of the week of ``today``: one row per key with days (values, absent ones 0), total and active_days.

    A day is active from ``least`` milliseconds on. Keys without a day in the week are left out.
    """
    monday = F.to_date(F.date_trunc("week", today))
    rows = daily.filter(F.col(day).between(monday, F.date_add(monday, 6))).groupBy(*keys, F.datediff(day, monday).alias("_d")).agg(F.sum(value).alias("_v"))
    values = [F.coalesce(F.max(F.when(F.col("_d") == d, F.col("_v"))), F.lit(0)).cast("long") for d in range(7)]
    return rows.groupBy(*keys).agg(F.array(*values).alias("days"), F.sum("_v").cast("long").alias("total"), F.count_if(F.col("_v") >= least).alias("active_days"))


def discovery_picks(works: DataFrame, progress: DataFrame, ident: str, day: str, shuffle: int = 0, size: int = 3) -> DataFrame:
    """``size`` series that nobody has begun, drawn by popularity; the same day and shuffle give the same ones.

    ``works`` has kind, available, views and comments; ``progress`` the works with a read or
    finished entry. One-shots and series of fewer than three available entries take no part.
    """
    fresh = works.filter((F.col("kind") != "oneshot") & (F.col("available") >= 3)).join(progress.select(ident), ident, "left_anti")
    seed = zlib.crc32(f"{day}#{shuffle}".encode())
    return weighted_sample(fresh, ident, discovery_weight(F.coalesce(F.col("views"), F.lit(0)) + 5 * F.coalesce(F.col("comments"), F.lit(0))), seed, size)
