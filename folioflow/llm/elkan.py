"""Vector codes by parts: Lloyd's rounds with Elkan's bounds, in whole numbers.

A vector is cut into parts, each with a small codebook of its own, and a code names the
nearest entry of every part. A round leaves out distances that bounds show to be larger:
each part keeps an upper bound of the distance to its entry and a lower bound for every
entry. Bounds are whole numbers (upper ones rounded up, lower ones down), and an entry is
left out only if it is strictly further away, so ties are always decided by exact squared
distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import join_weighted, materialise, own_dir, remove

SCALE = 4096
ENTRIES = 16
PARTS = 8
ROUNDS = 6
UNKNOWN = np.iinfo(np.int32).max  # an upper bound that excludes nothing


def _floor_root(x: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, of numbers below 2**62."""
    root = np.sqrt(x.astype(float)).astype(np.int64)
    root -= root * root > x
    return root + ((root + 1) * (root + 1) <= x)


def _ceil_root(x: np.ndarray) -> np.ndarray:
    root = _floor_root(x)
    return root + (root * root < x)


def part_bounds(dimension: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where parts begin and end; equal if ``parts`` divides the dimension."""
    cuts = [dimension * p // parts for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def nearest(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move every row of ``x`` to the nearest entry of ``book``, ties to the lower index.

    ``code``, ``upper`` and ``lower`` hold the entry, its upper bound and all lower bounds
    of each row and are brought up to date. Returns the number of distances computed.
    """
    between = _floor_root(((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2))

    def close() -> np.ndarray:
        """Entries that may be as near as a row's own: neither bound shows them further away."""
        found = (upper[:, None] >= lower) & (2 * upper[:, None] >= between[code])
        found[np.arange(len(x)), code] = False
        return found

    rows = np.flatnonzero(close().any(axis=1))
    own = ((x[rows] - book[code[rows]]) ** 2).sum(axis=1)
    upper[rows] = _ceil_root(own)
    lower[rows, code[rows]] = _floor_root(own)
    at, entry = np.nonzero(close()[rows])
    squared = ((x[rows[at]] - book[entry]) ** 2).sum(axis=1)
    lower[rows[at], entry] = _floor_root(squared)
    distance = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    distance[np.arange(len(rows)), code[rows]] = own
    distance[at, entry] = squared
    code[rows] = distance.argmin(axis=1)
    upper[rows] = _ceil_root(distance.min(axis=1)) if len(rows) else 0
    return len(rows) + len(at)


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of a list column, all of ``width`` numbers."""
    return pc.list_flatten(column.take(pa.array(rows))).to_numpy().reshape(len(rows), width)


def _lists(values: dict[int, np.ndarray], rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from a matrix for each group of rows; ``values`` maps rows to arrays."""
    return pa.array([values.get(k) for k in range(rows)], pa.list_(kind))


class Codebooks:
    """Entries of every part for vectors of each length: ``books[length]`` is (entries, length)."""

    def __init__(self, books: dict[int, np.ndarray], parts: int):
        self.books, self.parts = books, parts
        self.moves: dict[int, np.ndarray] = {}

    def updated(self, sums: dict[int, np.ndarray]) -> Codebooks:
        """Entries at the rounded-down mean of their parts; unused ones stay. ``moves``: how far, rounded up."""
        new = Codebooks({}, self.parts)
        for length, book in self.books.items():
            k = len(book)
            counts = sums[length][: self.parts * k].reshape(self.parts, k)
            totals = sums[length][self.parts * k :].reshape(k, length)
            after = book.copy()
            new.moves[length] = np.zeros((self.parts, k), np.int64)
            for p, (a, b) in enumerate(part_bounds(length, self.parts)):
                used = counts[p] > 0
                after[used, a:b] = totals[used, a:b] // counts[p][used, None]
                new.moves[length][p] = _ceil_root(((after[:, a:b] - book[:, a:b]) ** 2).sum(axis=1))
            new.books[length] = after
        return new

    def digest(self, length: int) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        numbers = [str(v) for a, b in part_bounds(length, self.parts) for entry in self.books[length][:, a:b].tolist() for v in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = pc.list_value_length(column).to_numpy()
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _assigned(batch: pa.RecordBatch, books: Codebooks):
    """For each length in a batch: its rows, vectors, codes, upper and lower bounds after a round.

    The first round has no bounds yet, and later ones shift them by the entries' movements.
    """
    for length, rows in _by_length(batch.column("vector")):
        book, parts = books.books[length], books.parts
        k = len(book)
        x = _matrix(batch.column("vector"), rows, length).astype(np.int64)
        if "code" in batch.schema.names:
            code = _matrix(batch.column("code"), rows, parts).astype(np.int64)
            upper = _matrix(batch.column("upper"), rows, parts).astype(np.int64)
            lower = _matrix(batch.column("lower"), rows, parts * k).astype(np.int64).reshape(len(rows), parts, k)
            moves = books.moves[length]
            upper = np.where(upper == UNKNOWN, UNKNOWN, upper + moves[np.arange(parts), code])
            lower = np.maximum(lower - moves, 0)
        else:
            code = np.zeros((len(rows), parts), np.int64)
            upper = np.full((len(rows), parts), UNKNOWN, np.int64)
            lower = np.zeros((len(rows), parts, k), np.int64)
        for p, (a, b) in enumerate(part_bounds(length, parts)):
            own = [code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()]
            nearest(x[:, a:b], book[:, a:b], *own)
            code[:, p], upper[:, p], lower[:, p] = own
        yield length, rows, x, code, upper, lower


def _sums(x: np.ndarray, code: np.ndarray, k: int, parts: int) -> np.ndarray:
    """Counts by part and entry, then the sums of components by entry and position."""
    counts, totals = np.zeros((parts, k), np.int64), np.zeros((k, x.shape[1]), np.int64)
    for p, (a, b) in enumerate(part_bounds(x.shape[1], parts)):
        chosen = code[:, p, None] == np.arange(k)
        counts[p] = chosen.sum(axis=0)
        totals[:, a:b] = chosen.T.astype(np.int64) @ x[:, a:b]
    return np.concatenate([counts.ravel(), totals.ravel()])


def _finite(vector) -> F.Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def compress(rows: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors after ``rounds`` rounds: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(``scale`` * x). The codebook of a part begins as that part of
    the ``entries`` smallest vec_ids (nulls last; rows of one vec_id in order of their
    components); with fewer rows it has fewer entries. Rows whose vector is null or holds
    null or non-finite components are left out. Vectors of different lengths have codebooks
    of their own; if ``parts`` doesn't divide a length, parts differ by one, and some of a
    very short vector are empty. Repeated rows count one by one, a null label is a label
    like any other, an empty table gives no rows, and other columns are ignored. Components
    whose squared distances could leave 64 bits (for 64 components: beyond 32,767) are an error.

    Every round is one pass over a table of vectors and bounds in the shared folder, which
    takes the place of the last round's. Sums for the next codebooks are made within each
    batch and stored with it; the driver gets those of all, a number per component of a
    codebook. Call it within ``_work.temporary`` to have the rest removed after use.
    """
    spark = rows.sparkSession
    named = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(_finite(F.col("embedding")))
    largest = F.coalesce(F.array_max(F.transform("embedding", lambda x: F.abs(x))), F.lit(0.0))
    sizes = {r["length"]: (r["n"], r["largest"]) for r in named.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"), F.max(largest).alias("largest")).collect()}
    for length, (_, most) in sizes.items():
        if (2 * (scale * most + 1)) ** 2 * max(1, length) >= 2**62 or scale * most >= 2**31 - 1:
            raise ValueError(f"components of up to {most} are too large for distances of 64 bits")
    vectors = materialise(named.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("vector")), "vectors")
    kinds = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}"

    books = {}
    for length in sizes:
        first = vectors.filter(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
        books[length] = np.array([r["vector"] for r in first], np.int64).reshape(len(first), length)
    codebooks = Codebooks(books, parts)

    state, before = vectors, None
    schema = f"{kinds}, vector array<int>, code array<tinyint>, upper array<int>, lower array<int>, sums array<bigint>"
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(codebooks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, uppers, lowers, sums = {}, {}, {}, {}
                for _, at, x, code, upper, lower in _assigned(batch, shared.value):
                    codes |= zip(at.tolist(), code.astype(np.int8), strict=True)
                    uppers |= zip(at.tolist(), np.minimum(upper, UNKNOWN).astype(np.int32), strict=True)
                    lowers |= zip(at.tolist(), np.minimum(lower, UNKNOWN).reshape(len(x), -1).astype(np.int32), strict=True)
                    sums[int(at[0])] = _sums(x, code, lower.shape[2], shared.value.parts)  # beside the first vector of this length
                n = len(batch)
                columns = [*map(batch.column, ("vec_id", "label", "vector")), _lists(codes, n, pa.int8()), _lists(uppers, n, pa.int32()), _lists(lowers, n, pa.int32()), _lists(sums, n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "code", "upper", "lower", "sums"])

        path = own_dir(spark, "elkan")
        state.mapInArrow(run, schema).write.parquet(path)
        if before:
            remove(spark, before)
        state, before = spark.read.schema(schema).parquet(path), path
        parted = state.filter(F.col("sums").isNotNull()).select(F.size("vector").alias("length"), F.posexplode("sums"))
        sums = {length: np.zeros((parts + length) * len(book), np.int64) for length, book in codebooks.books.items()}
        for r in parted.groupBy("length", "pos").agg(F.sum("col").alias("total")).collect():
            sums[r["length"]][r["pos"]] = r["total"]
        codebooks = codebooks.updated(sums)
        state = state.drop("sums")

    shared = spark.sparkContext.broadcast(codebooks)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, digests = ([None] * len(batch) for _ in range(3))
            for length, at, x, code, _, _ in _assigned(batch, shared.value):
                book, digest = shared.value.books[length], shared.value.digest(length)
                error = sum(((x[:, a:b] - book[code[:, p], a:b]) ** 2).sum(axis=1) for p, (a, b) in enumerate(part_bounds(length, shared.value.parts)))
                for k, own, e in zip(at.tolist(), code.astype(np.uint8), error.tolist(), strict=True):
                    texts[k], errors[k], digests[k] = own.tobytes().hex(), e, digest
            columns = [*map(batch.column, ("vec_id", "label")), pa.array(texts, pa.string()), pa.array(errors, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = materialise(state.mapInArrow(finish, f"{kinds}, code string, error long, codebooks_sha256 string"), "codes")
    if before:
        remove(spark, before)
    labels = coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    found = join_weighted(coded, labels, {"label": "same_label"}, "n", sum(n for n, _ in sizes.values()))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, all distances of all rounds."""

    def assign(n: int) -> str:
        squares = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"a{n} AS MATERIALIZED (SELECT vec_id, part, v.x, arg_min(entry, struct_pack(d := {squares}, e := entry)) AS entry, min({squares}) AS d FROM v JOIN c{n} c USING (part) GROUP BY vec_id, part, v.x)"

    def update(n: int) -> str:
        return f"""s{n} AS (SELECT part, entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS n FROM a{n}, generate_series(1, 8) g(pos) GROUP BY ALL),
  m{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS x FROM s{n} GROUP BY ALL),
  c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, entry))"""

    steps = ",\n  ".join(f"{assign(n)},\n  {update(n)}" for n in range(rounds))
    return f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda z: floor(4096 * z::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
  v AS MATERIALIZED (SELECT vec_id, part, x[8 * part + 1 : 8 * part + 8] AS x FROM kept, range(8) p(part)),
  first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
  c0 AS MATERIALIZED (SELECT part, entry, x FROM v JOIN first USING (vec_id)),
  {steps},
  {assign(rounds)},
  coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
  numbers AS (SELECT part, entry, pos, x[pos] AS n FROM c{rounds}, generate_series(1, 8) g(pos)),
  sha AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM numbers),
  labels AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
SELECT coded.vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN labels ON kept.label IS NOT DISTINCT FROM labels.label, sha
"""


ORACLE = oracle()
