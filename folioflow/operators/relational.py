"""Relational core: operational counts, latest rows, coverage, timelines and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def recovered_at(runs: DataFrame, run: str, at: str, failed: Column, fine: Column, groups: list[str]) -> DataFrame:
    """For each failed run of a group, the start of the next run that went well (null: none yet)."""
    later = Window.partitionBy(*groups).orderBy(at, run).rowsBetween(1, Window.unboundedFollowing)
    marked = runs.withColumn("recovered_at", F.min(F.when(fine, F.col(at))).over(later))
    return marked.filter(failed).select(*groups, run, F.col(at).alias("failed_at"), "recovered_at")


def keyset_page(rows: DataFrame, value: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """A page in order of value (descending, nulls last) and key, after the cursor (value, key)."""
    if after is not None:
        last, last_key = after
        nulls_left = F.col(value).isNull() & (F.col(key) > F.lit(last_key)) if last is None else F.col(value).isNull() | (F.col(value) < F.lit(last)) | ((F.col(value) == F.lit(last)) & (F.col(key) > F.lit(last_key)))
        rows = rows.filter(nulls_left)
    return rows.orderBy(F.col(value).desc_nulls_last(), F.col(key)).limit(size)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are in both tables, only in the left and only in the right."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("in_both"),
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
    )


def numbered(rows: DataFrame, *order: Column, keys: list[str] | tuple = ()) -> DataFrame:
    """Adds place, from 1, in ``order`` within each key (without keys: of a few rows only, in one task)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
