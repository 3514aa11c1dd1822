"""Synchronisation between devices: resolution per key, numbered pushes, pulls and outboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(operations: DataFrame, keys: list[str], at: str, value: str, progress: str, deleted: Column, permanent: Column) -> DataFrame:
    """One row per key: the later operation wins, ties go to the larger value, progress is the largest seen.

    A deletion is final for keys that are ``permanent``; for others a later write revives them.
    """
    rank = F.struct(at, value)
    return operations.groupBy(*keys).agg(
        F.max_by(value, rank).alias(value), F.max(at).alias(at), F.max(progress).alias(progress),
        (F.coalesce(F.bool_or(deleted & permanent), F.lit(False)) | F.coalesce(F.max_by(deleted, rank), F.lit(False))).alias("deleted"),
    )


def number_changes(operations: DataFrame, owner: str, op_id: str, order: str, base: int = 0) -> DataFrame:
    """Operations without repeats (the first of an id stays), numbered from ``base`` + 1 per owner in order."""
    first = F.row_number().over(Window.partitionBy(owner, op_id).orderBy(order))
    rows = operations.withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(owner).orderBy(order)) + base)


def pull(changes: DataFrame, owner: str, since: int, size: int) -> DataFrame:
    """For each owner the next ``size`` changes after ``since``, with more set where others follow."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy("revision"))
    rows = changes.filter(F.col("revision") > since).withColumn("_place", place).filter(F.col("_place") <= size + 1)
    rows = rows.withColumn("more", F.max("_place").over(Window.partitionBy(owner)) > size)
    return rows.filter(F.col("_place") <= size).drop("_place")


def compact_outbox(outbox: DataFrame, key: list[str], attempted: Column, order: str) -> DataFrame:
    """Attempted operations stay; of those never tried, only the newest of each key does."""
    newest = F.row_number().over(Window.partitionBy(*key, attempted).orderBy(F.desc(order)))
    return outbox.withColumn("_nth", newest).filter(attempted | (F.col("_nth") == 1)).drop("_nth")


def differences(local: DataFrame, baseline: DataFrame, key: str, value: str, guard: float = 0.5) -> DataFrame:
    """(key, change): put for new or other values, delete for those gone since the baseline.

    If more than the share ``guard`` of the baseline is gone, the local storage was lost and nothing is deleted.
    """
    old = baseline.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    rows = local.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is")).join(old, key, "full")
    change = F.when(F.col("_is").isNull(), "delete").when(F.col("_was").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")), "put")
    found = rows.select(key, change.alias("change")).filter("change IS NOT NULL")
    lost = found.filter("change = 'delete'").count() > guard * max(1, baseline.count())
    return found.filter("change <> 'delete'") if lost else found


def settle(local: DataFrame, pulled: DataFrame, key: str, at: str) -> DataFrame:
    """Local rows after a pull: the later of both, the pulled one on equal times; deleted ones stay as tombstones."""
    both = local.withColumn("_pulled", F.lit(0)).unionByName(pulled.withColumn("_pulled", F.lit(1)))
    fields = [c for c in local.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, "_pulled")).alias("_last"))
    return last.select(key, *(F.col(f"_last.{f}").alias(f) for f in fields))


def merge_history(states: DataFrame, key: str, at: str, progress: str, device: str) -> DataFrame:
    """One record per key of several devices' histories: the newest, but with the furthest progress of all."""
    fields = [c for c in states.columns if c not in (key, progress)]
    last = states.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, device)).alias("_last"), F.max(progress).alias(progress))
    return last.select(key, *(F.col(f"_last.{f}").alias(f) for f in fields), progress)


def merge_annotations(notes: DataFrame, key: str, at: str, deleted: str, text: str, device: str) -> DataFrame:
    """One row per annotation: a tombstone wins; else the last text, and the other texts as a sorted array of conflicts."""
    rows = notes.groupBy(key).agg(F.bool_or(deleted).alias("deleted"), F.max_by(text, F.struct(at, device)).alias("text"), F.sort_array(F.collect_set(text)).alias("_all"))  # an annotation has few versions
    return rows.select(key, "deleted", F.when(~F.col("deleted"), F.col("text")).alias("text"), F.when(~F.col("deleted"), F.array_remove("_all", F.col("text"))).otherwise(F.array().cast("array<string>")).alias("conflicts"))


def merge_sessions(sessions: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Sessions of several devices: the earliest start and the furthest end of each."""
    return sessions.groupBy(key).agg(F.min(start).alias(start), F.max(stop).alias(stop))


def merge_shelves(shelves: DataFrame, ident: str, name: str, at: str) -> DataFrame:
    """(id, canonical): shelves whose names are equal but for case and outer spaces become the one made first."""
    folded = F.lower(F.trim(F.col(name)))
    first = shelves.groupBy(folded.alias("_name")).agg(F.min_by(ident, F.struct(at, ident)).alias("canonical"))
    return shelves.select(ident, folded.alias("_name")).join(first, "_name").select(ident, "canonical")


def rekey(records: DataFrame, names: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """Records under the canonical names of their keys (alias, canonical), the newest of each kept."""
    moved = records.join(names.select(F.col("alias").alias(key), "canonical"), key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")
    fields = [c for c in records.columns if c != key]
    return moved.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, ident)).alias("_last")).select(key, *(F.col(f"_last.{f}").alias(f) for f in fields))


def sanitise(states: DataFrame, owner: str, at: str, ident: str, good: Column, most: int) -> DataFrame:
    """Well-formed states, at most the ``most`` newest of each owner."""
    newest = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(ident))
    return states.filter(F.coalesce(good, F.lit(False))).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def prune_operations(operations: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Operation ids that are still remembered."""
    return operations.filter(F.col(at) >= F.timestamp_add("DAY", F.lit(-days), now))
