"""The canonical store: tables as versioned folders of Parquet, checks of keys and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n), read from the footers of the files."""
    counts = [frame.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, frame in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def dangling(spark: SparkSession, tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(name, dangling) for each foreign key (table, column, parent, parent column); nulls refer to nothing."""
    out = None
    for table, column, parent, parent_column in keys:
        parents = tables[parent].select(F.col(parent_column).alias("_key"))
        found = tables[table].select(F.col(column).alias("_key")).filter("_key IS NOT NULL").join(parents, "_key", "left_anti").agg(F.lit(table).alias("name"), F.count("*").alias("dangling"))
        out = found if out is None else out.unionByName(found)
    return out


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def schema_faults(frame: DataFrame, expected: StructType) -> list[str]:
    """What differs from the expected columns: missing ones, other types and ones that are too many."""
    found = {f.name: f.dataType.simpleString() for f in frame.schema}
    wanted = {f.name: f.dataType.simpleString() for f in expected}
    faults = [f"missing {n}" for n in wanted if n not in found] + [f"unexpected {n}" for n in found if n not in wanted]
    return faults + [f"{n} is {found[n]}, not {wanted[n]}" for n in wanted if n in found and found[n] != wanted[n]]


def write_version(frame: DataFrame, root: str, table: str, version: int, shards: int | None = None, key: str | None = None) -> str:
    """Write a new version of a table; an existing version is never changed. With a key, rows are sharded by its remainder."""
    path = f"{root}/{table}/version={version:010d}"
    if shards and key:
        frame.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).write.partitionBy("shard").parquet(path)
    else:
        frame.write.parquet(path)
    return path


def read_version(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}/version={version:010d}")


def manifest(frame: DataFrame, name: str) -> DataFrame:
    """(name, n, content): count and a hash that does not depend on the order of the rows; repeated rows count."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in frame.columns)).cast("decimal(38,0)")
    return frame.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").alias("content"))


def append_new(frame: DataFrame, stored: DataFrame, sha: str) -> DataFrame:
    """The rows of which the hash is not stored yet, one for each hash."""
    return frame.dropDuplicates([sha]).join(stored.select(sha), sha, "left_anti")


def restore_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, fault) of each table of two manifests that differs: missing, unexpected, count or content."""
    old = expected.select("name", F.struct("n", "content").alias("_old"))
    rows = old.join(found.select("name", F.struct("n", "content").alias("_new")), "name", "full")
    fault = (
        F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "unexpected").when(F.col("_old.n") != F.col("_new.n"), "count")
        .when(~F.col("_old.content").eqNullSafe(F.col("_new.content")), "content")
    )
    return rows.select("name", fault.alias("fault")).filter("fault IS NOT NULL")
