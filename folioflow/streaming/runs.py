"""Streams over what is there: read all files once, write what the stream puts out, and give it as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.sources.shared import own_dir
from folioflow.streaming.stateful import PROVIDER

_STORE = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table's files, as a stream; ``path`` is a folder or one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may match a file


def run_once(stream: DataFrame, tag: str) -> DataFrame:
    """Run a stream over all that its source holds now and return its output, a table in the shared folder.

    The output has what the stream would have put out by then: windows, sessions and timers
    that the watermark has passed. A run that dies can be repeated from its checkpoint,
    which is beside the output.
    """
    spark = stream.sparkSession
    folder = own_dir(spark, tag)
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
