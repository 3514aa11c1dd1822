"""Shared folders for tables and files that outlive executors, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []  # folders of the temporary() blocks that are being run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``. Only a local session may go
    without: it gets a fresh temporary folder. A cluster without the setting is an
    error, since a machine-local folder would not be seen by other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/folioflow-{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, by Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised in this block are removed at its end, but for those of ``keep=True``.

    Kept tables belong to the block around this one, if there is any: whoever writes the
    result of an operator can run it in a block of its own and so leave nothing behind.
    """
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for path in mine:
            remove(spark, path)


def own_dir(spark: SparkSession, tag: str, *, keep: bool = False) -> str:
    """A fresh shared folder that goes with the ``temporary`` block (``keep``: the block around that)."""
    path = fresh_dir(spark, tag)
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append(path)
    return path


def materialise(df: DataFrame, tag: str, *, keep: bool = False, by: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result does not depend on executors that computed ``df``. ``keep``: it outlives
    the ``temporary`` block in which it is written. ``by``: a column of few values, the
    last one, by which the files are laid out. ``codec``: their compression.
    """
    spark = df.sparkSession
    path = own_dir(spark, tag, keep=keep)
    df.write.parquet(path, partitionBy=by, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
