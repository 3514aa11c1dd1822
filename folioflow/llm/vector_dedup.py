"""Near-duplicate vectors by an inverted multi-index with multi-sequence traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._work import materialise, temporary
from .topk import usable


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(-2 * part @ centres.T + (centres * centres).sum(1)).argmin(1) for part in np.array_split(x, 1 + len(x) // 4096)])
        order = np.argsort(own, kind="stable")
        seen, first = np.unique(own[order], return_index=True)
        centres[seen] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


@dataclass
class MultiIndex:
    """A codebook for each half of the vectors; ``visits`` is how many cells a search reads."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int = 1

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.books[0].shape[1]
        return [((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)) for part, book in zip((x[:, :cut], x[:, cut:]), self.books, strict=True)]

    def home(self, x: np.ndarray) -> np.ndarray:
        first, second = self._distances(x)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)

    def sequence(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, nearest first.

        The multi-sequence order of the product grid, for many vectors at once: the nth
        nearest cell is among the pairs (i, j) of sorted half-distances with
        (i + 1) * (j + 1) <= n, so only these are summed up and sorted.
        """
        first, second = self._distances(x)
        order = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        near = np.take_along_axis(first, order[0], 1), np.take_along_axis(second, order[1], 1)
        front = [(i, j) for i in range(min(count, first.shape[1])) for j in range(min(count // (i + 1), second.shape[1]))]
        i, j = np.array(front).T
        pick = np.argsort(near[0][:, i] + near[1][:, j], 1, kind="stable")[:, :count]
        return np.take_along_axis(order[0], i[pick], 1) * len(self.books[1]) + np.take_along_axis(order[1], j[pick], 1)

    def places(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The number of cells that come before the given one in each vector's traversal."""
        first, second = self._distances(x)
        rows = np.arange(len(x))
        far = first[rows, cells // len(self.books[1])] + second[rows, cells % len(self.books[1])]
        second.sort(1)
        return np.array([np.searchsorted(second[k], far[k] - first[k]).sum() for k in rows])


def fit(sample: np.ndarray, *, codes: int, cosine: float, recall: float, seed: int = 6) -> MultiIndex:
    """Codebooks by k-means on unit vectors, and as many visits as find pairs right at ``cosine``.

    Each sampled vector gets an artificial neighbour at exactly that cosine in a random
    direction. A pair is found if either of the two visits the other's cell, so ``visits``
    is the quantile ``recall`` of the earlier of their places in each other's traversal.
    Closer neighbours are found sooner.
    """
    rng = np.random.default_rng(seed)
    cut = sample.shape[1] // 2
    index = MultiIndex((_kmeans(sample[:, :cut], codes, rng), _kmeans(sample[:, cut:], codes, rng)))
    probe = sample[:2000]
    away = rng.normal(size=probe.shape)
    away -= (away * probe).sum(1)[:, None] * probe
    away /= np.maximum(np.linalg.norm(away, axis=1)[:, None], 1e-12)
    near = cosine * probe + np.sqrt(1 - cosine**2) * away
    place = np.minimum(index.places(probe, index.home(near)), index.places(near, index.home(probe)))
    index.visits = min(index.cells, int(np.ceil(np.quantile(place, recall))) + 1)
    return index


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least node that each of ``size`` nodes reaches over the edges (a, b)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
NEAR = pa.schema([("id", pa.int64()), ("visitor", pa.bool_())])


def near_duplicates(
    vectors: DataFrame, *, cosine: float = 0.95, recall: float = 0.97, cell_rows: int = 256, sample_rows: int = 32_768, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if they have the same length and their cosine, in double precision, is at
    least ``cosine``. Rows whose vector is null, empty, zero or holds null or non-finite
    components, or whose id is null, link with nothing and form a component of their own.
    Every length gets an index of its own. Repeated rows and equal vectors are copies of
    one another and link; different vectors are expected to have different ids. Ids that
    aren't whole numbers are an error. An empty table gives no rows; other columns are
    ignored.

    The codebooks are fitted on at most ``sample_rows`` vectors of each length (those of
    the smallest hashes); every row is indexed. The grid grows with the table: it has a
    cell for about ``cell_rows`` vectors, as long as the sample holds 32 vectors per code.
    Equal vectors are folded into one first. A vector visits the cells nearest to it until
    a pair at the very threshold is found, from either side, with probability ``recall``.

    Cells are cut into blocks of about ``block`` vectors, and a block of visitors meets a
    block of residents in one task. They first meet as vectors of one byte a component,
    with their rounding errors: only vectors for which a pair can't be ruled out are
    fetched whole. These are verified in double precision, and a task gives back sums and
    a spanning forest of its links, never the pairs.
    """
    spark = vectors.sparkSession
    # Components of floats are kept as they are; the arithmetic is in double precision.
    part = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{part}>").alias("v"))
    proper = F.coalesce(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    # -0.0 and 0.0 are the same component. Equal vectors are known by their length and two hashes.
    good = rows.filter(proper).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast(part)).alias("v"))
    keyed = good.select("vec_id", F.size("v").alias("dims"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("v"), "v").alias("h2"), "v")
    with temporary(spark):
        groups = materialise(keyed.groupBy("dims", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
        links = None
        for row in groups.groupBy("dims").count().orderBy("dims").collect():  # a row per length
            # Of repeated rows with one id one stands for all; it is looked up by id and hashes, so no vectors are shuffled for it but theirs.
            own = groups.filter(F.col("dims") == row["dims"]).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "id", "copies")
            mine = keyed.filter(F.col("dims") == row["dims"]).join(own, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("vec_id") == F.col("id")))
            mine = materialise(mine.select("id", "copies", "h1", "v").dropDuplicates(["id", "h1"]), "vectors")
            found = _links(mine, row["count"], row["dims"], part, cosine=cosine, recall=recall, cell_rows=cell_rows, sample_rows=sample_rows, block=block)
            links = found if links is None else links.unionAll(found)
        links = spark.createDataFrame([], "id long, links long, root long") if links is None else links
        counts = links.groupBy("id").agg(F.sum("links").alias("links"))
        parts = components(links.filter("root IS NOT NULL AND root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
        linked = groups.join(counts, "id", "left").join(parts, "id", "left").filter("links IS NOT NULL OR copies > 1 OR component_id IS NOT NULL")
        linked = linked.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        linked = materialise(linked, "vector-groups", keep=True)
    known = rows.select("vec_id", F.when(proper, F.transform("v", lambda x: x + F.lit(0.0).cast(part))).alias("v"))
    known = known.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("v"), "v")).alias("h2"))
    out = known.join(linked, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(groups: DataFrame, count: int, dims: int, part: str, *, cosine: float, recall: float, cell_rows: int, sample_rows: int, block: int) -> DataFrame:
    """(id, links, root) of distinct vectors of one length, as a table; an id may have several rows."""
    spark = groups.sparkSession
    sample = groups.orderBy(F.xxhash64(F.lit("codebook"), "id"), "id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    x = sample.flatten().to_numpy().astype(float).reshape(-1, dims)
    codes = max(1, min(int(np.ceil(np.sqrt(count / cell_rows))), len(x) // 32))
    index = fit(x / np.linalg.norm(x, axis=1)[:, None], codes=codes, cosine=cosine, recall=recall)
    shared = spark.sparkContext.broadcast(index)

    def units(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        return x / np.linalg.norm(x, axis=1)[:, None]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x = units(batch.column("v"))
                home = index.home(x).astype(np.int32)
                visits = [np.union1d(row, [own]).astype(np.int32) for row, own in zip(index.sequence(x, index.visits).astype(np.int32), home, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, visits)]), pa.int32()), pa.array(np.concatenate(visits), pa.int32()))
                scale = np.abs(x).max(1) / 127
                coarse = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - coarse * scale[:, None], axis=1)
                columns = [batch.column("id"), pa.array(home), lists, pa.array([c.tobytes() for c in coarse], pa.binary()), pa.array(scale), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "home", "visits", "coarse", "scale", "error"])

    read = materialise(groups.select("id", "v").mapInArrow(traverse, "id long, home int, visits array<int>, coarse binary, scale double, error double"), "multi-index")

    def blocks(table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """Residents and visitors, each dealt to the blocks of cells in which they meet."""
        residents = table.select(F.col("home").alias("cell"), *columns)
        visitors = table.select(F.explode("visits").alias("cell"), *(F.col(c).alias(c) for c in columns))
        in_cell = residents.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("r_blocks"))
        at_cell = visitors.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("v_blocks"))
        cells = materialise(in_cell.join(at_cell, "cell"), "cells")
        own = lambda n, tag: F.pmod(F.xxhash64(F.lit(tag), "id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        residents = residents.join(cells, "cell").withColumn("r", own("r_blocks", "r")).withColumn("w", every("v_blocks"))
        visitors = visitors.join(cells, "cell").withColumn("w", own("v_blocks", "w")).withColumn("r", every("r_blocks"))
        return residents.select("cell", "r", "w", *columns), visitors.select("cell", "r", "w", *columns)

    keys = ["cell", "r", "w"]

    def possible(key: tuple, inside: pa.Table, outside: pa.Table) -> pa.Table:
        """The ids of residents and visitors that may have a link here, going by one byte a component."""
        if not len(inside) or not len(outside):
            return NEAR.empty_table()
        sides = []
        for table in (outside, inside):
            scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
            coarse = np.frombuffer(b"".join(table.column("coarse").to_pylist()), np.int8).reshape(len(table), dims)
            sides.append((table.column("id").to_numpy(), (coarse * scale[:, None]).astype("f4"), error))
        (v_id, v, v_error), (r_id, r, r_error) = sides
        # |x.y - x'.y'| <= |x - x'| + |y - y'| + |x - x'||y - y'| for unit vectors x and y; floats of 4 bytes add less than 1e-5.
        near = v @ r.T + (1 + v_error[:, None]) * (1 + r_error[None, :]) - 1 >= cosine - 1e-5
        near &= v_id[:, None] != r_id[None, :]
        some_v, some_r = v_id[near.any(1)], r_id[near.any(0)]
        return pa.table([pa.array(np.concatenate([some_v, some_r])), pa.array([True] * len(some_v) + [False] * len(some_r), pa.bool_())], schema=NEAR)

    def verify(key: tuple, inside: pa.Table, outside: pa.Table) -> pa.Table:
        if not len(inside) or not len(outside):
            return FOUND.empty_table()
        r_id, v_id = inside.column("id").to_numpy(), outside.column("id").to_numpy()
        r_copies, v_copies = inside.column("copies").to_numpy(), outside.column("copies").to_numpy()
        v_home = outside.column("home").to_numpy()
        close = units(outside.column("v").combine_chunks()) @ units(inside.column("v").combine_chunks()).T >= cosine
        close &= v_id[:, None] != r_id[None, :]
        v, r = np.nonzero(close)
        if not len(v):
            return FOUND.empty_table()
        # A pair counts for both sides here, unless the resident will find the visitor itself.
        lists = inside.column("visits").combine_chunks()
        visited = np.repeat(np.arange(len(r_id)), np.diff(lists.offsets.to_numpy())) * shared.value.cells + lists.flatten().to_numpy()
        alone = ~np.isin(r * shared.value.cells + v_home[v], visited)
        v_links = np.bincount(v, r_copies[r], len(v_id))
        r_links = np.bincount(r[alone], v_copies[v[alone]], len(r_id))
        ids, place = np.unique(np.concatenate([v_id, r_id]), return_inverse=True)
        root = ids[_forest(place[v], place[len(v_id) + r], len(ids))]
        links = np.bincount(place, np.concatenate([v_links, r_links]), len(ids)).astype(np.int64)
        some = (links > 0) | (root != ids)
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], schema=FOUND)

    residents, visitors = blocks(read, "id", "coarse", "scale", "error")
    flagged = residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(possible, "id long, visitor boolean")
    flagged = materialise(flagged.select("id").distinct(), "possible")
    # Vectors that may link meet once more, whole, in cells and blocks of their own.
    whole = materialise(groups.select("id", "copies", "v").join(read.select("id", "home", "visits"), "id").join(flagged, "id", "left_semi"), "whole")
    residents, visitors = blocks(whole, "id", "copies", "home", "visits", "v")
    found = residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(verify, "id long, links long, root long")
    return materialise(found, "vector-links")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
