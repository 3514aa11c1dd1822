"""Joins on the Jaccard similarity of word n-grams, with prefix filters under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._text import _M, SPACES, Words, batch_words, byte_values, mix64, signed
from ._work import materialise, short_batches, temporary

_TABLE = byte_values(SPACES)
BUCKETS = 1 << 20  # of shingle counts; a fixed size, whatever the corpus
CHUNK = 1 << 14
ORDERS = 3
STARS = 4
SALTS = 256
FEWEST_WORDS, MOST_WORDS = 1 << 16, 1 << 22
SIDE = 4096


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; shorter texts are one shingle."""
    h = words.hashes
    count = max(0, len(h) - n + 1)
    joined = np.full(count, n, np.uint64)
    for k in range(n):
        joined = joined * np.uint64(_M) + h[k : k + count]
    joined = mix64(joined)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            yield np.unique(joined[lo : hi - n + 1])
        elif hi > lo:
            short = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                short = short * np.uint64(_M) + h[k]
            yield mix64(short, 7)
        else:
            yield np.zeros(0, np.uint64)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, words in batch_words(column, _TABLE):
        yield from shingle_sets(words, n)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


SUMMARY = "doc_id long, n int, print_1 long, print_2 long, least array<long>, chunk int, part int, counts binary"


def summarise(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (size and fingerprints of its set, its least shingle under ``STARS`` random orders),

    and rows of counts: how many documents of a task hold a shingle of each bucket, in chunks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("print_1", pa.int64()), ("print_2", pa.int64()), ("least", pa.list_(pa.int64())), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            size, first, second, least = [], [], [], []
            for x in _sets(batch.column("text"), n):
                size.append(len(x))
                first.append(int(mix64(x, 11).sum(dtype=np.uint64)))
                second.append(int(np.bitwise_xor.reduce(mix64(x, 12), initial=np.uint64(0))))
                least.append(signed(np.array([mix64(x, 20 + k).min() for k in range(STARS)])).tolist() if len(x) else [])
                np.add.at(counts, (x >> np.uint64(44)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(size), pa.int32())
            columns = [batch.column("doc_id"), pa.array(size, pa.int32()), *(pa.array(signed(np.array(v, np.uint64))) for v in (first, second)), pa.array(least, pa.list_(pa.int64())), none, none, pa.nulls(len(size), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        part = TaskContext.get().partitionId() // 256
        pa.default_memory_pool().release_unused()
        rows = [{"chunk": c, "part": part, "counts": counts[c * CHUNK : (c + 1) * CHUNK].tobytes()} for c in range(BUCKETS // CHUNK)]
        yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SUMMARY)


def frequency_classes(counts: DataFrame) -> np.ndarray:
    """For each bucket the binary logarithm of its count over all documents, one byte each."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint64 if len(x) == 8 * CHUNK else np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = counts.select("chunk", "part", "counts").groupBy("chunk", "part").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    total = np.zeros(BUCKETS, np.uint64)
    for row in sums.collect():  # always BUCKETS numbers in all
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint64)
    return np.log2(total.astype(float) + 1).astype(np.uint8)


def prefixes(docs: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """The prefix of each document's set under every order.

    Orders put shingles of rarer buckets first and differ in how they mix those of one
    frequency class. Sets that are similar enough share a shingle of their prefixes
    (|x| - ceil(percent |x| / 100) + 1 shingles) under each order. The first order's prefix
    is given as shingles, the others' as 32-bit digests, all in their order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    others = [f"prefix_{k}" for k in range(1, ORDERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            size, found = [], [[] for _ in range(ORDERS)]
            for x in _sets(batch.column("text"), n):
                p = len(x) - -(-percent * len(x) // 100) + 1 if len(x) else 0
                size.append(len(x))
                rank = classes[(x >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                for k in range(ORDERS):
                    order = rank | mix64(x, 40 + k) >> np.uint64(8)
                    chosen = x[np.argsort(order)[:p]]
                    found[k].append(signed(chosen) if k == 0 else (chosen >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(found[0], pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.int32())) for x in found[1:])], ["doc_id", "n", "tokens", *others])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "doc_id long, n int, tokens array<long>, " + ", ".join(f"{x} array<int>" for x in others))


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of document ids whose sets are similar, from whole texts.

    Texts travel once to each leader (a) that asks for them. A leader's members are spread
    over ``SALTS`` parts, each with the leader's text in front of it.
    """
    pairs = materialise(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")), "pairs")
    members = pairs.select(F.col("b").alias("id"), F.col("a").alias("leader"), "salt", F.lit(1).alias("member"))
    leaders = pairs.select(F.col("a").alias("id"), F.col("a").alias("leader"), "salt", F.lit(0).alias("member")).distinct()
    wanted = members.unionByName(leaders)
    # A filter of eight bits or more for each text that is asked for lets few others into the
    # shuffle. It is broadcast, so it grows to MOST_WORDS rows of 12 bytes only; beyond some
    # hundred million texts it lets more others pass, which costs but changes nothing.
    words = min(MOST_WORDS, max(FEWEST_WORDS, 1 << (pairs.count() // 4).bit_length()))
    word = lambda x: F.pmod(F.xxhash64(F.lit("bits"), x), F.lit(words)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit("bit"), x), F.lit(64)).cast("int"))
    bits = F.broadcast(wanted.select(word(F.col("id")).alias("word"), bit(F.col("id")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))  # at most MOST_WORDS rows of 12 bytes
    near = docs.join(bits, (word(F.col("doc_id")) == F.col("word")) & (F.col("bits").bitwiseAND(bit(F.col("doc_id"))) != 0), "left_semi")
    texts = wanted.join(near, F.col("id") == F.col("doc_id"))
    texts = texts.select("leader", "salt", "member", "id", "text").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            a, b = [], []
            for x, group, member, doc in zip(_sets(batch.column("text"), n), batch.column("leader").to_pylist(), batch.column("member").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if not member:
                    leader, own = group, x
                elif leader == group and similar(own, x, percent):
                    a.append(group)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id.

    Two documents link if ``100 * intersection >= percent * union`` of their sets of
    ``n``-word shingles; component_id is the smallest doc_id reachable by links. Documents
    without words or text have an empty set and link with nothing. Rows with equal doc_id
    count as one document; without a doc_id a row links with nothing and its component is
    null. Ids that aren't whole numbers are an error. Very long texts are read whole. An
    empty table gives no rows; other columns are ignored.

    1. Documents with equal sets are one class, and only its smallest doc_id goes on.
    2. Those whose least shingle under one of a few random orders agrees are compared with
       the smallest doc_id among them. This joins large groups of near copies at a cost in
       proportion to their size; it only saves work, as the next step finds all links of
       what is still apart.
    3. Of what is still apart, all pairs that share a prefix shingle are candidates if
       their prefixes meet under every one of ``ORDERS`` global orders; all of these are
       verified. No candidate is dropped, so no link between components is lost.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with temporary(docs.sparkSession), short_batches(docs.sparkSession):
        summary = materialise(summarise(docs, n), "shingles", keep=True)
        classes = frequency_classes(summary.filter("chunk IS NOT NULL"))
        summary = summary.filter("chunk IS NULL").select("doc_id", "n", "print_1", "print_2", "least")
        whole = summary.filter("n > 0 AND doc_id IS NOT NULL")
        groups = materialise(whole.groupBy("n", "print_1", "print_2").agg(F.min("doc_id").alias("id")), "classes")
        named = materialise(whole.join(groups, ["n", "print_1", "print_2"]).select("doc_id", "n", "id", F.when(F.col("doc_id") == F.col("id"), F.col("least")).alias("least")), "named")
        chosen = named.filter("doc_id = id").dropDuplicates(["doc_id"]).select("doc_id", "n", "least")

        stars = chosen.select("doc_id", "n", F.posexplode("least").alias("star", "least"))
        heads = materialise(stars.groupBy(F.col("star").alias("h_star"), F.col("least").alias("h_least")).agg(F.min_by("n", "doc_id").alias("h_n"), F.min("doc_id").alias("head"), F.count("*").alias("size")).filter("size > 1"), "heads")
        alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
        near = stars.join(heads, (F.col("star") == F.col("h_star")) & (F.col("least") == F.col("h_least"))).filter((F.col("doc_id") != F.col("head")) & alike(F.col("n"), F.col("h_n")))
        links = materialise(verify(near.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), docs, n, percent), "links")
        parts = components(links)
        placed = materialise(chosen.select("doc_id", "n").join(parts.withColumnRenamed("id", "p_id"), F.col("doc_id") == F.col("p_id"), "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("part")), "parts")

        ordered = materialise(prefixes(docs.filter("doc_id IS NOT NULL"), classes, n, percent), "prefixes")
        postings = ordered.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
        common = postings.groupBy(F.col("token").alias("c_token")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("c_token")
        shared = postings.join(materialise(common, "common"), F.col("token") == F.col("c_token"), "left_semi")
        shared = materialise(shared.join(placed.withColumnRenamed("doc_id", "p_id"), F.col("doc_id") == F.col("p_id")).select("token", "pos", "doc_id", "n", "part"), "shared")
        # Shingles within one component only have nothing left to tell. Of the others, the
        # documents outside a shingle's largest component meet all documents of another one.
        sides = shared.groupBy("token", "part").count()
        sides = sides.groupBy(F.col("token").alias("s_token")).agg(F.count("*").alias("parts"), F.max_by("part", F.struct("count", "part")).alias("main"), F.ceil((F.sum("count") - F.max("count")) / SIDE).cast("int").alias("salts")).filter("parts > 1").select("s_token", "main", "salts")
        shared = materialise(shared.join(materialise(sides, "sides"), F.col("token") == F.col("s_token")).drop("s_token"), "shared")
        # A shingle with many documents outside its main component has them in so many parts.
        left = shared.filter("part <> main").select(*(F.col(c).alias(f"l_{c}") for c in shared.columns), F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("l_salt"))
        right = shared.select(*(F.col(c).alias(f"r_{c}") for c in shared.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("r_salt"))
        # Similar sets share so many shingles at least, so the first shared one has a place early enough in both.
        overlap = lambda x, y: F.ceil((x + y) * percent / (100 + percent))
        least = overlap(F.col("l_n"), F.col("r_n"))
        apart = (F.col("l_part") != F.col("r_part")) & ((F.col("r_part") == F.col("r_main")) | (F.col("l_doc_id") < F.col("r_doc_id")))
        early = (F.col("l_pos") <= F.col("l_n") - least) & (F.col("r_pos") <= F.col("r_n") - least)
        pairs = left.join(right, (F.col("l_token") == F.col("r_token")) & (F.col("l_salt") == F.col("r_salt")) & apart & alike(F.col("l_n"), F.col("r_n")) & early)
        pairs = materialise(pairs.select(F.least("l_doc_id", "r_doc_id").alias("a"), F.greatest("l_doc_id", "r_doc_id").alias("b")).distinct(), "candidates")
        others = [f"prefix_{k}" for k in range(1, ORDERS)]
        first = ordered.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), *(F.col(c).alias(f"a_{c}") for c in others))
        second = ordered.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), *(F.col(c).alias(f"b_{c}") for c in others))
        least = overlap(F.col("a_n"), F.col("b_n"))
        begins = lambda side, c: F.slice(f"{side}_{c}", F.lit(1), F.greatest(F.lit(0), F.col(f"{side}_n") - least + 1).cast("int"))
        meeting = pairs.join(first, "a").join(second, "b").filter(alike(F.col("a_n"), F.col("b_n")))
        for c in others:
            meeting = meeting.filter(F.arrays_overlap(begins("a", c), begins("b", c)))
        late = materialise(verify(meeting.select("a", "b").distinct(), docs, n, percent), "links")
        parts = components(links.unionByName(late))
        final = named.select("doc_id", "id").distinct().join(parts.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").groupBy(F.col("doc_id").alias("f_id")).agg(F.min(F.coalesce("component_id", "id")).alias("component_id"))
        final = materialise(final, "components", keep=True)
    return summary.join(final, F.col("doc_id") == F.col("f_id"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one of the smallest doc_id.

    Rows of one doc_id are one document, so one of them stays; rows without a doc_id all do.
    """
    found = similar_documents(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.join(found, F.col("doc_id") == F.col("kept_id"), "left_semi").unionByName(docs.filter("doc_id IS NULL"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least ON a = doc_id
"""
