"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import materialise, temporary


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node that has an edge; component_id is its smallest node.

    ``edges`` has long columns a and b; loops and rows with nulls are left out. Alternates
    two steps until nothing changes: each node sends its larger neighbours to the least
    node around it, then its smaller neighbours and itself. Both are a minimum per node,
    summed up before the shuffle, and a join that Spark can split at a node with many
    edges. Every step is a table in the shared folder. Repeated edges count once; without
    edges there are no rows.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialise(edges.filter("a <> b").select(larger, smaller).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        with temporary(edges.sparkSession):
            around = now.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("least")).unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("least")))
            least = materialise(around.groupBy("node").agg(F.least(F.min("least"), F.first("node")).alias("least")), "least")
            outward = now.join(least, F.col("b") == F.col("node")).select("a", F.col("least").alias("b"))
            now = materialise(outward.distinct(), "edges")
            least = materialise(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "least")
            inward = now.join(least, F.col("a") == F.col("node")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
            now = materialise(inward.filter("a <> b").distinct(), "edges", keep=True)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    # Every node but the least of a component now has one edge, to that least node.
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))
