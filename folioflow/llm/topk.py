"""Exact top-k search by inner product: KD-trees per shard, traversed best-first."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import materialise, temporary


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


@dataclass
class Tree:
    """Points in leaf order with ids, and nodes: tight boxes, ranges of points, children (-1: leaf) and least id."""

    points: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    least: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = 64) -> Tree:
        """Split at the median of the widest dimension until at most ``leaf`` points or equal points remain."""
        order = np.arange(len(ids))
        rows: list[list] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            begin, stop, parent, side = todo.pop()
            own = points[order[begin:stop]]
            low, high = own.min(0), own.max(0)
            rows.append([low, high, begin, stop, -1, -1, ids[order[begin:stop]].min()])
            if parent >= 0:
                rows[parent][4 + side] = len(rows) - 1
            spread = high - low
            if stop - begin > leaf and spread.size and spread.max() > 0:
                middle = (stop - begin) // 2
                order[begin:stop] = order[begin:stop][np.argpartition(own[:, spread.argmax()], middle)]
                at = len(rows) - 1
                todo += [(begin, begin + middle, at, 0), (begin + middle, stop, at, 1)]
        columns = [np.array(x) for x in zip(*rows, strict=True)]
        low, high, begin, stop, left, right, least = columns
        return cls(points[order], ids[order], low, high, begin, stop, left, right, least)

    def bounds(self, nodes, query: np.ndarray) -> np.ndarray:
        """The most that the product of the query and a point in each node's box can be."""
        return np.maximum(self.low[nodes] * query, self.high[nodes] * query).sum(-1)

    def search(self, query: np.ndarray, own: int, k: int, kth: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, without the id ``own``.

        ``kth``: a score that k other points are known to reach; worse points don't matter.
        """
        best: list[tuple[int, int]] = []  # a heap: the worst on top, as (score, -id)
        queue = [(-int(self.bounds(0, query)), int(self.least[0]), 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if kth is not None and -bound < kth or len(best) == k and (-bound, -least) <= best[0]:
                if kth is not None and -bound < kth or -bound < best[0][0]:
                    break  # all that remain are no better
                continue
            if self.left[node] >= 0:
                children = [int(self.left[node]), int(self.right[node])]
                for child, value in zip(children, self.bounds(children, query).tolist(), strict=True):
                    heapq.heappush(queue, (-value, int(self.least[child]), child))
                continue
            ids = self.ids[self.begin[node] : self.stop[node]]
            scores = self.points[self.begin[node] : self.stop[node]] @ query
            floor = max(x for x in (kth, best[0][0] if len(best) == k else None, np.iinfo(np.int64).min) if x is not None)
            good = np.flatnonzero((scores >= floor) & (ids != own))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[:k]]
            for j in good.tolist():
                item = (int(scores[j]), -int(ids[j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(score, -i) for score, i in sorted(best, reverse=True)]

    FIELDS = ("points", "ids", "low", "high", "begin", "stop", "left", "right", "least")

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), np.int64).tobytes() for name in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict, dims: int) -> Tree:
        arrays = [np.frombuffer(row[name], np.int64) for name in cls.FIELDS]
        arrays[0], arrays[2], arrays[3] = (x.reshape(-1, dims) if dims else x.reshape(len(y), 0) for x, y in ((arrays[0], arrays[1]), (arrays[2], arrays[4]), (arrays[3], arrays[4])))
        return cls(*arrays)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Top:
    """A tree of median splits that deals vectors out to leaves: axis and cut of each node, children (-1: a leaf) and leaf numbers."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaves: int) -> Top:
        """Split the largest node at the median of its widest dimension until there are ``leaves`` or all rest are equal points."""
        rows = [[0, 0, -1, -1, -1]]
        open_nodes = [(-len(points), 0, points)]
        done = []
        while open_nodes and len(open_nodes) + len(done) < leaves:
            _, at, own = heapq.heappop(open_nodes)
            spread = own.max(0) - own.min(0) if len(own) and own.shape[1] else np.zeros(1, np.int64)
            if spread.max() == 0:
                done.append(at)
                continue
            axis = int(spread.argmax())
            values = own[:, axis]
            cut = int(np.partition(values, len(values) // 2)[len(values) // 2])
            if not (values < cut).any():
                cut = int(values[values > cut].min())
            rows[at][:4] = [axis, cut, len(rows), len(rows) + 1]
            for side in (values < cut, values >= cut):
                heapq.heappush(open_nodes, (-int(side.sum()), len(rows), own[side]))
                rows.append([0, 0, -1, -1, -1])
        for number, at in enumerate([*done, *(at for _, at, _ in open_nodes)]):
            rows[at][4] = number
        return cls(*(np.array(c) for c in zip(*rows, strict=True)))

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.left[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(points[inner, self.axis[at]] < self.cut[at], self.left[at], self.right[at])
        return self.leaf[node]


PAIRS = "query_id long, dims int, shard long, bound double, nth int"


def _likely(queries: DataFrame, boxes: DataFrame, slices: int) -> DataFrame:
    """Shards that may hold vectors for a query, by their boxes: ``PAIRS``, nth in order of falling bounds.

    ``queries`` have vec_id, dims, q, kth and home. Boxes go to the tasks in ``slices``, one
    after the other; a bound is rounded up, so it is never too low.
    """
    spark = queries.sparkSession
    out = None
    for part in range(slices):
        rows = boxes.filter(F.pmod(F.xxhash64("shard"), F.lit(slices)) == part).collect()
        packed: dict[int, tuple] = {}
        for dims in {r["dims"] for r in rows}:
            own = [r for r in rows if r["dims"] == dims]
            low, high = (np.array([np.frombuffer(r[n], np.int64) if dims else () for r in own], float).reshape(len(own), dims) for n in ("low", "high"))
            packed[dims] = np.array([r["shard"] for r in own], np.int64), low, high
        shared = spark.sparkContext.broadcast(packed)

        def bounds(batches, shared=shared):
            for batch in batches:
                found = []
                for dims in set(batch.column("dims").to_pylist()) & set(shared.value):
                    shard, low, high = shared.value[dims]
                    asked = batch.filter(pc.equal(batch.column("dims"), dims))
                    for at in range(0, len(asked), 256):
                        some = asked.slice(at, 256)
                        q = _matrix(pa.chunked_array([some.column("q")]), dims).astype(float)
                        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                        most += np.abs(most) * 1e-9 + 1
                        kth = some.column("kth").to_numpy(zero_copy_only=False).astype(float)  # null: nan, which excludes nothing
                        may = ~(most < kth[:, None]) & (shard[None, :] != some.column("home").to_numpy()[:, None])
                        order = np.argsort(-most, axis=1, kind="stable")
                        chosen = np.take_along_axis(may, order, axis=1)
                        nth = np.cumsum(chosen, axis=1) - 1
                        row, place = np.nonzero(chosen)
                        which = order[row, place]
                        found.append((some.column("vec_id").to_numpy()[row], np.full(len(row), dims, np.int32), shard[which], most[row, which], nth[row, place].astype(np.int32)))
                for columns in found:
                    for at in range(0, len(columns[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], ["query_id", "dims", "shard", "bound", "nth"])

        pairs = queries.select("vec_id", "dims", "q", "kth", "home").mapInArrow(bounds, PAIRS)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def top_k(vectors: DataFrame, *, k: int = 5, query_step: int = 50, shard_rows: int = 16_384, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
          sample: int = 65_536, most_leaves: int = 1024, rounds: tuple[int, ...] = (8, 64), box_bytes: int = 64 << 20, meetings: list | None = None) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row whose id is divisible by ``query_step``.

    Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller id. Rows whose
    id or vector is null, or whose vector holds null or non-finite components, take no
    part; vectors meet only those of their own length. Ids that aren't whole numbers are an
    error. A query is compared with every
    row of another id; equal queries (repeated rows) are answered once, and repeated
    candidates count one by one. Scores are exact while they fit in a long. An empty
    table gives no rows; other columns are ignored.

    Rows are dealt out to at most ``most_leaves`` leaves of median splits, which are found on
    at most about ``sample`` vectors, and within a leaf to shards of about ``shard_rows`` by a
    hash; each shard gets a tree. A query searches its own shard first. With the kth score
    found there it goes to the shards whose boxes may hold better ones, in ``rounds``: first
    to so many of the highest bounds, then up to so many, then to all that are left; after
    each round the kth score has risen and more shards drop out. The boxes of all shards
    go to tasks ``box_bytes`` at a time. ``meetings`` gets the number of queries that met a
    shard in each round, and of all pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", quantised(F.col("v")).alias("q")).withColumn("dims", F.size("q"))
    with temporary(spark):
        rows = materialise(rows, "vectors")
        counts = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().filter(F.col("count") > shard_rows).collect()}  # lengths that need several shards
        total = max(1, sum(counts.values()))
        tops: dict[int, Top] = {}
        for dims, n in counts.items():
            share = min(1.0, sample / total)
            some = rows.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64(F.lit("top"), "vec_id", "q"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("q")
            found = [r["q"] for r in some.collect()]
            points = np.array(found, np.int64).reshape(len(found), dims)
            if len(points):
                tops[dims] = Top.build(points, max(1, min(most_leaves, -(-n // shard_rows), -(-len(points) // 16))))
        shared = spark.sparkContext.broadcast(tops)

        def deal(batches):
            for batch in batches:
                leaf = np.zeros(len(batch), np.int64)
                lengths = batch.column("dims").to_numpy()
                for dims in set(lengths.tolist()) & set(shared.value):
                    at = np.flatnonzero(lengths == dims)
                    leaf[at] = shared.value[dims].leaves(_matrix(pa.chunked_array([batch.column("q").take(pa.array(at))]), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        dealt = materialise(rows.mapInArrow(deal, "vec_id long, q array<long>, dims int, leaf long"), "leaves")
        per_leaf = dealt.groupBy(F.col("dims").alias("l_dims"), F.col("leaf").alias("l_leaf")).agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
        rows = dealt.join(per_leaf, (F.col("dims") == F.col("l_dims")) & (F.col("leaf") == F.col("l_leaf")))
        rows = rows.select("vec_id", "q", "dims", (F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "q"), F.col("parts"))).alias("shard"))
        rows = materialise(rows, "shards")

        def plant(key: tuple, table: pa.Table) -> pa.Table:
            dims = key[0].as_py()
            tree = Tree.build(_matrix(table.column("q"), dims).astype(np.int64), table.column("vec_id").to_numpy())
            return pa.Table.from_pylist([{"dims": dims, "shard": key[1].as_py(), **tree.packed()}], pa.schema([("dims", pa.int32()), ("shard", pa.int64()), *((n, pa.binary()) for n in Tree.FIELDS)]))

        trees = materialise(rows.groupBy("dims", "shard").applyInArrow(plant, "dims int, shard long, " + ", ".join(f"{n} binary" for n in Tree.FIELDS)), "kd-trees")
        queries = materialise(rows.filter(F.col("vec_id") % query_step == 0).distinct(), "queries")
        keys = ["dims", "shard", "query_block"]

        def search(key: tuple, tree: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(tree) or not len(asked):
                return HITS.empty_table()
            dims = key[0].as_py()
            planted = Tree.unpacked(tree.to_pylist()[0], dims)
            found = []
            for query, own, kth in zip(_matrix(asked.column("q"), dims), asked.column("vec_id").to_pylist(), asked.column("kth").to_pylist(), strict=True):
                found += [(own, i, score) for score, i in planted.search(query, own, k, kth)]
            return pa.table([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], schema=HITS)

        def ask(asked: DataFrame) -> DataFrame:
            """Search shards for queries in blocks; a tree goes where its shard has a block."""
            most = asked.groupBy("dims", "shard").count().agg(F.max("count")).first()[0] or 1
            asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-most // block))).cast("int"))
            blocks = asked.select(*(F.col(c).alias(f"b_{c}") for c in keys)).distinct()
            planted = trees.join(blocks, (F.col("dims") == F.col("b_dims")) & (F.col("shard") == F.col("b_shard")))
            planted = planted.select("dims", "shard", F.col("b_query_block").alias("query_block"), *Tree.FIELDS)
            return planted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

        def best(hits: DataFrame) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)

        def kths(hits: DataFrame) -> DataFrame:
            return hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

        hits = materialise(best(ask(queries.withColumn("kth", F.lit(None).cast("long")))), "top-k-home")
        shards = trees.count()
        met = []
        if shards > 1:
            boxes = trees.select("dims", "shard", *(F.substring(F.col(n), F.lit(1), 8 * F.col("dims")).alias(n) for n in ("low", "high")))
            slices = max(1, -(-boxes.agg(F.sum(F.octet_length("low") + F.octet_length("high"))).first()[0] // box_bytes))
            asking = queries.join(kths(hits), F.col("vec_id") == F.col("query_id"), "left").drop("query_id").withColumnRenamed("shard", "home")
            pairs = materialise(_likely(asking, boxes, slices), "likely")
            low = 0
            for high in (*rounds, 1 << 31):
                now = kths(hits).withColumnRenamed("query_id", "k_id")
                due = pairs.filter((F.col("nth") >= low) & (F.col("nth") < high)).join(now, F.col("query_id") == F.col("k_id"), "left")
                due = due.filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("query_id", "shard", "kth")
                asked = materialise(due.join(queries.select("vec_id", "q", "dims"), F.col("query_id") == F.col("vec_id")).drop("query_id"), "due")
                met.append(asked.count())
                if met[-1]:
                    hits = materialise(best(hits.drop("rank").unionByName(ask(asked))), "top-k-round")
                low = high
        if meetings is not None:
            meetings[:] = [met, queries.count() * (shards - 1)]
        return materialise(hits.select("query_id", "rank", "vec_id", "score"), "top-k", keep=True)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
