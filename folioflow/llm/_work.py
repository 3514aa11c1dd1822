"""Shared folders, as in the rest of the library, and a join that splits frequent keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.shared import fresh_dir, materialise, own_dir, remove, shared_dir, shuffle_partitions, temporary

__all__ = ["fresh_dir", "join_weighted", "materialise", "own_dir", "remove", "shared_dir", "short_batches", "shorten_batches", "shuffle_partitions", "temporary"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shorten_batches(spark: SparkSession) -> None:
    """From now on Python gets whole rows of about 4 MB at a time, in this session.

    Otherwise a batch is up to 64 MB of text, which stands in the buffers of the JVM and
    in each Python worker at once, and what they took for it they keep.
    """
    spark.conf.set(BATCH_BYTES, "4m")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """``shorten_batches`` for the tables that are written in this block."""
    before = spark.conf.get(BATCH_BYTES)
    shorten_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def join_weighted(big: DataFrame, small: DataFrame, keys: dict[str, str], weight: str, total: int) -> DataFrame:
    """Inner join of ``big`` with the one row of ``small`` for each key; null keys are equal.

    ``keys`` names the key columns of ``big`` and their fellows in ``small``; ``weight``
    counts the rows of ``big`` that a row of ``small`` meets, ``total`` all of them. Rows
    that meet more than a thousandth of ``total`` (10,000 at least) are at most a thousand:
    these are broadcast, so that no task gets all rows of a frequent key.
    """
    heavy = F.col(weight) >= max(10_000, total // 1000)
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()])
    hot = small.filter(heavy)
    often = F.broadcast(hot.select(*keys.values()))
    rest = big.join(often, same, "left_anti").join(small.filter(~heavy), same)
    return big.join(F.broadcast(hot), same).unionByName(rest).drop(*keys.values())
