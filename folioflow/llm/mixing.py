"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import materialise, shuffle_partitions, temporary

#: Shuffled documents of a source fall into so many runs (three hexadecimal digits), which
#: are summed on their own; only the sums of the runs meet.
RUNS = 4096
SALTS = 64
#: Least number of ranges of finish time up to time 1, and words in a range beyond that number.
RANGES = 4096
RANGE_WORDS = 10_000_000
#: Documents of more than this share of their source, or these words if that is less, queue in pieces.
PIECES = 1024
LEAST_PIECE = 64


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5, 2, 1), budget=1.5, repeats=2) -> DataFrame:
    """One row per source: its size, weight and target.

    Sources in order of code point, null last, take ``weights`` in turn and share
    ``budget`` times all sizes in proportion. No target exceeds ``repeats`` times the
    source's size; what a source can't use is shared again among the others. The
    common level is found in closed form over sources sorted by size over weight.

    Sources are put in order in one task; their number is expected to fit there (millions
    of rows of a few numbers), while their documents are never gathered.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * repeats).alias("most"),
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    per = per.withColumn("common", F.max(fits).over(everything))
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("common") * F.col("weight")), F.col("most").cast("double"))
    total = F.sum("source_size").over(everything)
    most_words = F.least(F.floor(total * F.lit(float(budget))), total * repeats).cast("long")
    return per.select("source", "source_size", "weight", target.alias("target"), total.cast("long").alias("all_size"), most_words.alias("budget"))


def fair_queue(docs: DataFrame, *, weights=(5, 2, 1), budget=1.5, repeats=2, seed="mix-1", keep=()) -> DataFrame:
    """The queue: one row per input row, pass over its source and piece.

    ``docs`` needs doc_id, text and source; columns named in ``keep`` are carried along.
    A source's documents are shuffled by a hash of their id and queue ``repeats`` times. A
    document's virtual finish time is its source's words up to its end over the source's
    target. All rows are put in order of finish time over all sources (ties by source), by
    ranges of that time, and are taken until the total budget is used up; the row in which
    it ends is taken in part. A document of more than a thousandth of its source (or 64
    words) queues in pieces, each with a finish time of its own, so no source is further
    from its target than by that.

    Columns: row_key (identifies the input row), doc_id, source, size, source_size,
    target, pass_no, piece, piece_size, finish, position (words of the mix before it),
    taken (words of the piece that the mix takes: 0 behind its end), and ``keep``.

    Null or empty texts have size 0; they queue as one empty piece, of which nothing is
    taken. Null sources form a source. Repeated rows count one by one; equal rows tie and
    any order of them gives equal results. Very long texts are counted whole. An empty
    table gives an empty queue. Other columns are ignored. Sizes and sums are kept as a
    table of numbers in the shared folder, so texts are read once; call it within
    ``_work.temporary`` to have that removed after use.
    """
    spread = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread.alias("spread"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    sized = materialise(sized, "sizes")
    targets = source_targets(sized.select("source", "size"), weights, budget, repeats)
    # A source may hold a third of all rows: they meet their target's row on many salts.
    salted = targets.select(F.col("source").alias("t_source"), "source_size", "target", "all_size", "budget", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    sized = sized.withColumn("run", F.conv(F.substring("spread", 1, 3), 16, 10).cast("int"))
    sized = sized.withColumn("salt", F.col("run") % SALTS)
    sized = sized.join(salted, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt")))

    in_run = Window.partitionBy("source", "run").orderBy("spread", "doc_id", "size")
    kept = [f"kept_{c}" for c in keep]
    rows = sized.select(
        "doc_id", "source", "run", "size", "source_size", "target", "all_size", "budget", *kept,
        F.row_number().over(in_run).alias("nth"),
        F.coalesce(F.sum("size").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_before"),
    )
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    runs = runs.select(
        F.col("source").alias("r_source"), F.col("run").alias("r_run"),
        F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("runs_before"),
    )
    rows = rows.join(runs, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("run") == F.col("r_run")))
    rows = rows.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    longest = F.greatest(F.lit(LEAST_PIECE), F.floor(F.col("source_size") / PIECES)).cast("long")
    rows = rows.withColumn("longest", longest).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("longest")) - 1))))
    rows = rows.withColumn("piece_size", F.least("longest", F.col("size") - F.col("piece") * F.col("longest")))
    end = F.col("pass_no") * F.col("source_size") + F.col("runs_before") + F.col("run_before") + F.col("piece") * F.col("longest") + F.col("piece_size")
    rows = rows.withColumn("end", end).withColumn("finish", F.when(F.col("target") > 0, F.col("end") / F.col("target")).otherwise(F.lit(0.0)))
    # Positions over the whole mix: sums within ranges of finish time, then over the ranges.
    ranges = F.greatest(F.lit(RANGES), F.floor(F.col("all_size") / RANGE_WORDS))
    # Empty texts have no share in the sums. They go to ranges of their own, before the first.
    rows = rows.withColumn("range", F.when(F.col("piece_size") > 0, F.floor(F.col("finish") * ranges)).otherwise(-1 - F.col("run")).cast("long"))
    sums = rows.groupBy("range").agg(F.sum("piece_size").alias("words"))
    # A number per range, some thousands times the largest finish time, or a few million for 100 TB.
    places = sums.select(F.col("range").alias("p_range"), F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("place"))
    in_range = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "end", "doc_id", "nth")
    queued = rows.join(places, F.col("range") == F.col("p_range"))
    before = F.coalesce(F.sum("piece_size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queued = queued.withColumn("position", (F.col("place") + before).cast("long"))
    taken = F.greatest(F.lit(0), F.least(F.col("piece_size"), F.col("budget") - F.col("position"))).cast("long")
    return queued.withColumn("taken", taken).select(
        F.struct("source", "run", "nth").alias("row_key"), "doc_id", "source", "size", "source_size", "target", "pass_no", "piece", "piece_size", "finish",
        "position", "taken", *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, position and finish.

    ``taken`` are the words of all its passes in the mix, ``position`` the words of the mix
    before its first and ``finish`` the virtual time at which its last one there is served;
    both are null if nothing of it is taken. Nulls, empty texts, ties, repeated rows and
    other columns are as in ``fair_queue``; an empty table gives no rows.
    """
    with temporary(docs.sparkSession):
        sized = docs.select("doc_id", "source", "text")
        queue = fair_queue(sized, **options)
        per = queue.groupBy("row_key").agg(F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("position"))).alias("position"), F.max(F.when(F.col("taken") > 0, F.col("finish"))).alias("finish"), F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        return materialise(per.select("doc_id", "size", "source_size", "target", "taken", "position", "finish"), "mixed", keep=True)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs``.

    Rows are in the order of the queue: partition by partition, and within each. The
    document in which a source's part of the mix ends is cut after the words that are taken
    of it (single spaces between them), and a column n_chars then counts the cut text. Rows
    that are equal in doc_id, source and text are one document, taken as often as the queue
    says for all of them. Columns may have any names; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    columns = [f"c{k}" for k in range(len(docs.columns))]
    own = lambda name: F.col(columns[docs.columns.index(name)])
    plain = docs.toDF(*columns)
    # Two hashes and the length tell documents apart, at any number of them.
    plain = plain.withColumn("key", F.struct(F.xxhash64(own("doc_id"), own("source"), own("text")).alias("a"), F.xxhash64(F.lit("mix"), own("text"), own("source"), own("doc_id")).alias("b"), F.length(own("text")).alias("n")))
    with temporary(spark):
        queue = fair_queue(plain.select(own("doc_id").alias("doc_id"), own("source").alias("source"), own("text").alias("text"), "key"), keep=("key",), **options).filter("taken > 0")
        # One row per document and pass of one input row; a document of many equal rows is never gathered.
        times = queue.groupBy("key", "row_key", "pass_no").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.min("position").alias("position"))
        times = materialise(times.select(F.col("key").alias("of"), "taken", "size", "position"), "takes", keep=True)
    length = times.agg(F.max("position")).first()[0]
    rows = plain.dropDuplicates(["key"]).join(times, F.col("key") == F.col("of"))
    words = F.filter(F.split(own("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short = F.col("taken") < F.col("size")
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")).otherwise(own("text"))
    rows = rows.withColumn(columns[docs.columns.index("text")], text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn(columns[docs.columns.index("n_chars")], F.when(short, F.length(own("text")).cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars")))
    # Positions are known, so ranges of them can be dealt out without a look at the rows.
    parts = shuffle_partitions(spark)
    rows = rows.repartitionById(parts, F.floor(F.col("position") * parts / ((length or 0) + 1)).cast("int")).sortWithinPartitions("position")
    return rows.select(*(F.col(c).alias(name) for c, name in zip(columns, docs.columns, strict=True)))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS spread
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS most,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
     - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
common AS (SELECT *, max(CASE WHEN level <= most::DOUBLE / weight THEN level END) OVER () AS common FROM levels),
targets AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, common * weight), most::DOUBLE) AS target,
         least(floor(1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE), (2 * sum(source_size) OVER ())::DOUBLE)::BIGINT AS budget,
         greatest(64, source_size // 1024) AS longest
  FROM common),
queued AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, t.budget, t.longest,
         row_number() OVER (PARTITION BY s.source ORDER BY s.spread, s.doc_id, s.size) AS nth,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spread, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT *, least(longest, size - piece * longest) AS piece_size,
         pass_no * source_size + before + piece * longest + least(longest, size - piece * longest) AS stop
  FROM (SELECT *, unnest(range(0, greatest(1, (size + longest - 1) // longest))) AS piece FROM (SELECT *, unnest([0, 1]) AS pass_no FROM queued))),
placed AS (
  SELECT *, coalesce(sum(piece_size) OVER (ORDER BY CASE WHEN target > 0 THEN stop / target ELSE 0 END, source NULLS LAST, stop, doc_id, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position
  FROM pieces),
served AS (SELECT *, greatest(0, least(piece_size, budget - position)) AS words FROM placed)
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken, min(CASE WHEN words > 0 THEN position END)::BIGINT AS position,
       max(CASE WHEN words > 0 THEN stop / target END) AS finish
FROM served GROUP BY source, nth, doc_id, size, source_size, target
"""
