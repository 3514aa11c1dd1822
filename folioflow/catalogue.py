"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "b1_count_by_state"


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("b1_count_by_state", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def count_by_state(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
