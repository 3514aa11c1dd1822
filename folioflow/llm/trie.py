"""The prefix trie of conversations: a node for every distinct beginning.

A node belongs to its smallest member. A member of a node that is the smallest of all is
also the smallest of every deeper node on its way, so each conversation owns the end of its
path, from some depth on, or nothing. That makes sums over subtrees sums over members: a
node's subtree holds the turns of its members from its depth on, and of these each
conversation's own ones are the nodes' single copies.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import join_weighted, materialise, shuffle_partitions, temporary

#: Conversations of so many following ids begin alike, with at most ``HEADS - 1`` turns of the first of them.
FAMILY = 100
HEADS = 6
#: Ids that are joined to one text before they are hashed.
IDS = 256
#: Four sums of 32 random bits for every turn and its place: the key of a beginning.
KEY = ["k1", "k2", "k3", "k4"]


def _key_parts(place: Column, digest: Column) -> dict[str, Column]:
    first, second = (F.xxhash64(F.lit(seed), place, digest) for seed in ("first", "second"))
    low = F.lit(0xFFFFFFFF)
    return {"k1": first.bitwiseAND(low), "k2": F.shiftrightunsigned(first, 32), "k3": second.bitwiseAND(low), "k4": F.shiftrightunsigned(second, 32)}


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns with their place in their conversation, from 1, by ranges of rows.

    A range is a block that any task can number on its own; a conversation of very many
    turns goes over several blocks, whose counts are summed up.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), role.alias("role"), F.length(text).cast("long").alias("tokens"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # Equal rows are alike, so any of them may go to the next range.
    spread = [*order, F.monotonically_increasing_id()]
    turns = materialise(turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", *spread).withColumn("block", F.spark_partition_id()), "turns")
    nth = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).cast("long")
    return turns.select("conv_id", "block", nth.alias("nth"), "digest", "tokens")


def rebuild(conversations: DataFrame) -> DataFrame:
    """Turns of all rebuilt conversations, and a row of depth 0 for each: conv_id, block, depth, digest, tokens, length.

    A conversation begins with the first h turns of the first one of its hundred, then
    goes on with its own after its first h; h is CRC-32 of its id modulo 6. ``length`` is
    its number of turns. Tables of both steps are in the shared folder.
    """
    turns = materialise(_ordered(conversations), "places")
    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("own"))
    heads = turns.join(blocks, ["conv_id", "block"]).withColumn("place", F.col("before") + F.col("nth")).filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "tokens"))).alias("head"))  # at most five
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    whole = blocks.groupBy("conv_id").agg(F.first("own").alias("own"))
    whole = whole.withColumns({"shared": shared, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(heads, "base", "left")
    whole = whole.withColumn("head", F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), lambda t: t["place"] <= F.col("shared")))
    whole = whole.withColumn("length", F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("shared")))
    whole = materialise(whole.select("conv_id", "shared", "head", F.col("length").cast("long").alias("length")), "rebuilt")
    begin = whole.select("conv_id", F.lit(-1).alias("block"), "length", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("tokens"))), "head")).alias("turn"))
    begin = begin.select("conv_id", "block", F.col("turn.place").alias("depth"), "turn.digest", "turn.tokens", "length")
    # A conversation of very many turns meets its row block by block.
    shift = blocks.join(whole, "conv_id").select("conv_id", "block", "before", "shared", F.size("head").alias("begun"), "length")
    place = F.col("before") + F.col("nth")
    rest = turns.join(shift, ["conv_id", "block"]).filter(place > F.col("shared"))
    rest = rest.select("conv_id", "block", (F.col("begun") + place - F.col("shared")).cast("long").alias("depth"), "digest", "tokens", "length")
    return materialise(begin.unionByName(rest), "rebuilt-turns")


def _paths(turns: DataFrame) -> DataFrame:
    """For every turn the key of its beginning and that of the one before it, and the tokens before it and in all.

    Keys are running sums, so blocks are summed on their own and then one after the other.
    """
    parts = turns.select("*", *[c.alias(k) for k, c in _key_parts(F.col("depth"), F.col("digest")).items()]).drop("digest")
    parts = parts.withColumns({k: F.when(F.col("depth") > 0, F.col(k)).otherwise(0) for k in KEY})
    sums = [*KEY, "tokens"]
    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = parts.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"sum_{c}") for c in sums])
    carried = [F.coalesce(F.sum(f"sum_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"carried_{c}") for c in sums]
    blocks = blocks.select("conv_id", "block", *carried, F.sum("sum_tokens").over(Window.partitionBy("conv_id")).alias("all_tokens"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.join(blocks, ["conv_id", "block"]).withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"carried_{c}") for c in sums})
    return parts.select(
        "conv_id", "block", "depth", "length", "tokens", "all_tokens", (F.col("run_tokens") - F.col("tokens")).alias("before"),
        *[F.col(f"run_{k}").alias(k) for k in KEY], *[(F.col(f"run_{k}") - F.col(k)).alias(f"parent_{k}") for k in KEY],
    )


def owned(paths: DataFrame, salts: int) -> DataFrame:
    """(conv_id, owned_from, owned_before, leaves) of every conversation that owns nodes.

    A window over the members of a node marks the smallest one. Members fall into
    ``salts`` parts first, so that a frequent beginning meets in no one task.
    ``owned_before``: tokens of the turns before its own nodes; ``leaves``: 1 if it owns
    the childless node at its end.
    """
    node = ["depth", *KEY]
    rows = paths.select(*node, "conv_id", "length", "before", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).alias("salt"))
    for keys in ([*node, "salt"], node):
        members = Window.partitionBy(*keys)
        first = F.row_number().over(members.orderBy("conv_id")) == 1
        rows = rows.select(*rows.columns, first.alias("first"), F.max("length").over(members).alias("longest")).filter("first").drop("first", "length").withColumnRenamed("longest", "length")
    leaf = (F.col("length") == F.col("depth")).cast("long")
    return rows.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.min("before").alias("owned_before"), F.max(leaf).alias("leaves"))


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of every node at which a conversation ends.

    Ids are sorted by ranges and joined to texts of at most ``IDS`` of them; a node's texts
    then pass in order through one hash, which takes them as they come.
    """
    node = ["depth", *KEY]
    kind = ", ".join(f"{c} long" for c in node)
    ranges = shuffle_partitions(paths.sparkSession)
    ends = paths.filter("depth = length").select(*node, "conv_id").repartitionByRange(ranges, *node, "conv_id").sortWithinPartitions(*node, "conv_id")

    def rows(batches: Iterator[pa.RecordBatch], last: str):
        for batch in batches:
            yield from zip(zip(*(batch.column(c).to_pylist() for c in node), strict=True), batch.column(last).to_pylist(), strict=True)

    def tables(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for key, members in itertools.groupby(rows(batches, "conv_id"), lambda r: r[0]):
                while ids := [i for _, i in itertools.islice(members, IDS)]:
                    yield *key, ids[0], ",".join(map(str, ids))

        return tables(texts(), [*node, "first_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes():
            for key, texts in itertools.groupby(rows(batches, "ids"), lambda r: r[0]):
                total = hashlib.sha256()
                for n, (_, text) in enumerate(texts):
                    total.update(("," * (n > 0) + text).encode())
                yield *key, total.hexdigest()

        return tables(hashes(), [*node, "ends_sha256"])

    joined = ends.mapInArrow(join, f"{kind}, first_id long, ids string")
    return joined.repartition(ranges, *node).sortWithinPartitions(*node, "first_id").mapInArrow(digest, f"{kind}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of their number, nulls first; turns of one number by role, then by
    a hash of role and text. Null roles and texts are empty. Repeated rows are turns of
    their own, rows without a conv_id are left out, other columns are ignored, very long
    texts are hashed whole, and an empty table gives no rows. Beginnings are told apart by
    128 bits of hashes. Call it within ``_work.temporary``; its tables are removed at the end.
    """
    spark = conversations.sparkSession
    node = ["depth", *KEY]
    with temporary(spark):
        turns = rebuild(conversations)
        paths = materialise(_paths(turns), "paths", keep=True)
    marks = materialise(owned(paths, max(32, shuffle_partitions(spark))), "owned")
    marked = paths.select("conv_id", "block").distinct().join(marks, "conv_id", "left")
    rows = paths.join(marked, ["conv_id", "block"])
    never = F.coalesce(F.col("owned_from"), F.lit(2**62))
    saved = F.greatest(F.lit(0), F.coalesce("owned_before", "all_tokens") - F.col("before"))
    nodes = rows.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("depth") < F.col("length")) & (never <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
        *[F.first(f"parent_{k}").alias(f"parent_{k}") for k in KEY],
    )
    nodes = materialise(nodes, "nodes")
    found = nodes.join(_ends(paths), node, "left")
    found = found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).withColumn("parent_depth", F.col("depth") - 1)
    parents = nodes.select(F.col("depth").alias("p_depth"), *[F.col(k).alias(f"p_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight")).filter("weight > 0")
    keys = {"parent_depth": "p_depth"} | {f"parent_{k}": f"p_{k}" for k in KEY}
    below = join_weighted(found.filter("depth > 0"), parents, keys, "weight", nodes.count())
    root = found.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*names).unionByName(root.select(*names))


ORACLE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                         lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
turns AS (
  SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS tokens,
         list(length(role) || ':' || role || length(text) || ':' || text) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
occurrences AS (
  SELECT conv_id, depth, tokens, path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM occurrences GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM occurrences JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT d.path AS below, path[:u.depth] AS path FROM nodes d, generate_series(0, d.depth) u(depth)),
subtrees AS (
  SELECT a.path, sum((n.n_convs - 1) * n.tokens)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM above a JOIN nodes n ON n.path = a.below LEFT JOIN children c ON c.path = a.below GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN children c USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""
