"""Merges of observations into the versioned store: joins and folds instead of updates.

Each fold has an explicit order column, so its result does not depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_values(rows: DataFrame, keys: list[str], fields: list[str], *order: str) -> DataFrame:
    """The last non-null value of each field per key: a null never replaces what is known."""
    rank = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields))


def fold_captures(captures: DataFrame, key: str, version: Column, at: str, order: str, views: str) -> DataFrame:
    """One row per post from its captures in ``order``.

    n_versions counts distinct contents, changes the captures whose content differs from
    the one before (returning to an older version is a change, too), latest_version is
    the content of the last capture and views the largest count seen.
    """
    seen = Window.partitionBy(key).orderBy(order)
    rows = captures.select(key, order, at, views, version.alias("_version"))
    rows = rows.withColumn("_changed", ~F.col("_version").eqNullSafe(F.lag("_version").over(seen)) | (F.row_number().over(seen) == 1))
    return rows.groupBy(key).agg(
        F.count_distinct("_version").alias("n_versions"),
        F.count_if("_changed").alias("changes"),
        F.max_by("_version", order).alias("latest_version"),
        F.max(views).alias("views"),
        F.max(at).alias("last_seen_at"),
        F.count("*").alias("captures"),
    )


def repeats(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds outcome: stored for the first row of a key, unchanged for every later one."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("outcome", F.when(nth == 1, "stored").otherwise("unchanged"))


def availability(captures: DataFrame, key: str, run: str, order: str, gone: Column, fine: Column) -> DataFrame:
    """missing once two different runs since the last success have found nothing, else available or unknown."""
    marked = captures.select(key, run, order, gone.alias("_gone"), fine.alias("_fine"))
    last = marked.groupBy(key).agg(F.max(F.when(F.col("_fine"), F.col(order))).alias("_last"))
    rows = marked.join(last, key).withColumn("_after", F.col("_gone") & (F.col("_last").isNull() | (F.col(order) > F.col("_last"))))
    counts = rows.groupBy(key).agg(F.count_distinct(F.when(F.col("_after"), F.col(run))).alias("missing_runs"), F.first("_last").alias("_last"))
    state = F.when(F.col("missing_runs") >= 2, "missing").when(F.col("_last").isNotNull(), "available").otherwise("unknown")
    return counts.select(key, "missing_runs", state.alias("availability"))


def import_batch(current: DataFrame, incoming: DataFrame, key: str, raw_hash: str, canonical_hash: str, replaceable: Column) -> DataFrame:
    """(key, status) of each incoming item: accepted, duplicate, equivalent_duplicate, replaced or held_conflict."""
    old = current.select(key, F.col(raw_hash).alias("_raw"), F.col(canonical_hash).alias("_canonical"), F.lit(True).alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "accepted").when(F.col("_raw").eqNullSafe(F.col(raw_hash)), "duplicate")
        .when(F.col("_canonical").eqNullSafe(F.col(canonical_hash)), "equivalent_duplicate").when(replaceable, "replaced").otherwise("held_conflict")
    )
    return incoming.join(old, key, "left").select(key, status.alias("status"))


def chapter_status(old: Column, new: Column) -> Column:
    """Joins two states of a chapter: complete stays; review and held outlive discovered; waiting outlives unknown."""
    return (
        F.when(old.isNull(), new).when(new.isNull() | (old == "complete"), old).when(old.isin("review", "held") & (new == "discovered"), old)
        .when((old == "waiting") & (new == "unknown"), old).otherwise(new)
    )


def publish(old: DataFrame, new: DataFrame, key: str, sha: str, verified_at: str) -> DataFrame:
    """Publication records; the time of verification is kept as long as the hash is the same."""
    before = old.select(key, F.col(sha).alias("_sha"), F.col(verified_at).alias("_at"))
    joined = new.join(before, key, "full")
    same = F.col(sha).eqNullSafe(F.col("_sha")) | F.col(sha).isNull()
    return joined.select(key, F.coalesce(sha, "_sha").alias(sha), F.when(same, F.col("_at")).otherwise(F.col(verified_at)).alias(verified_at))


def discover(stored: DataFrame, listed: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Posts after a listing: unknown ones are added, of known ones a null never replaces what is known.

    The title is taken from the listing only while no version of the post exists; count and
    last_seen_at are always the listing's. Needs title, author, category, created_at, count,
    latest_version_id and first_seen_at, last_seen_at in ``stored``; the listing has one row
    per post, with the first five and ``at``.
    """
    fields = ("title", "author", "category", "created_at", "count")
    new = listed.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.col(at).alias("_at"))
    rows = stored.join(new, keys, "full")
    seen = F.col("_at").isNotNull()
    return rows.select(
        *keys,
        F.when(F.col("latest_version_id").isNull() & seen, F.coalesce("_title", "title")).otherwise(F.col("title")).alias("title"),
        *(F.coalesce(f"_{f}", f).alias(f) for f in ("author", "category", "created_at")),
        F.when(seen, F.col("_count")).otherwise(F.col("count")).alias("count"), "latest_version_id",
        F.coalesce("first_seen_at", "_at").alias("first_seen_at"), F.greatest("last_seen_at", "_at").alias("last_seen_at"),
    )


def replace_children(stored: DataFrame, incoming: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The children (comments) of the changed parents give way to the incoming ones; all others stay.

    A task holds its share of the changed keys; children pass by without being sorted.
    """
    changed = changed.select(key).distinct().hint("shuffle_hash")
    return stored.join(changed, key, "left_anti").unionByName(incoming.join(changed, key, "left_semi"))


def touch(stored: DataFrame, seen: DataFrame, key: str, times: list[str], at: str) -> DataFrame:
    """Posts that were found unmodified: only their times move, and never back."""
    last = seen.groupBy(key).agg(F.max(at).alias("_at"))
    return stored.join(last, key, "left").withColumns({t: F.greatest(t, "_at") for t in times}).drop("_at")


def overwrite(stored: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key wins whole, nulls included; incoming rows come after stored ones."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    fields = [c for c in stored.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("_new", *order)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{f}").alias(f) for f in fields))


def keep_filled(old: Column, new: Column) -> Column:
    """The new text unless it is blank."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def keep_first(old: Column, new: Column) -> Column:
    """The old text unless it is empty: for names that must not change, and for numbers that only fill gaps."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def segment_outcomes(stored: DataFrame, built: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, outcome, superseded): created, unchanged or updated segments, and the hash that an update puts out of use."""
    old = stored.select(key, F.col(sha).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col(sha), "unchanged").otherwise("updated")
    return built.join(old, key, "left").select(key, outcome.alias("outcome"), F.when(outcome == "updated", F.col("_old")).alias("superseded"))


def episode_outcome(paid: Column, old_sha: Column, new_sha: Column, old_canonical: Column, new_canonical: Column) -> Column:
    """waiting for a paid body, imported for a new one, kept for an equal or equivalent one, else held_conflict."""
    return F.when(paid, "waiting").when(old_sha.isNull(), "imported").when((old_sha == new_sha) | F.coalesce(old_canonical == new_canonical, F.lit(False)), "kept").otherwise("held_conflict")


def add_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those incoming ones of which the key isn't there; what is there stays as it is."""
    fresh = incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh)


def guarded_status(stored: DataFrame, reports: DataFrame, key: str, at: str, arrival: str, kept: list[str], limit: Column) -> DataFrame:
    """The stored status of each key after its reports in order of arrival, one row a key.

    A report older than what is known loses, but a stored time after ``limit`` (a clock that
    ran ahead) yields to any; reports after ``limit`` or without a time are refused. Fields
    in ``kept`` keep their last value where a report has none, all others are replaced.
    Ties in ``arrival`` go to the later time, then to the greater row.
    """
    fields = [c for c in stored.columns if c != key]
    old = stored.select(key, *fields, F.lit(0).alias("_new"), F.lit(None).cast(reports.schema[arrival].dataType).alias("_arrival"))
    new = reports.filter(F.col(at) <= limit).select(key, *fields, F.lit(1).alias("_new"), F.col(arrival).alias("_arrival"))
    order = F.struct("_new", "_arrival", at, *(f for f in fields if f != at))
    rows = old.unionByName(new).withColumns({"_order": order, "_known": F.when((F.col("_new") == 1) | (F.col(at) <= limit), F.col(at))})
    before = Window.partitionBy(key).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_best", F.max("_known").over(before)).filter((F.col("_new") == 0) | F.col("_best").isNull() | (F.col(at) >= F.col("_best")))
    last = F.col("_order")
    return rows.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), last) if f in kept else last).alias(f) for f in fields))
