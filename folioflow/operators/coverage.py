"""Runs, boards and passes: states, coverage, order and reports of an archive's operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.paging import numbered_by_blocks
from folioflow.sources.shared import materialise, temporary


def latest_codes(captures: DataFrame, run: str, url: str, order: str, code: str) -> DataFrame:
    """The distinct error codes of each run, of the last capture of every URL only."""
    last = captures.groupBy(run, url).agg(F.max_by(code, order).alias(code))
    return last.filter(F.col(code).isNotNull()).select(run, code).distinct()


def run_status(outcomes: Column, scheduled: Column, item_failures: Column, codes: Column, harmless: list[str]) -> Column:
    """succeeded, partial (something came in) or failed.

    ``outcomes`` is the number of outcomes, ``codes`` an array of failure codes, of which
    ``harmless`` ones don't count. A run whose outcomes differ from what was scheduled is incomplete.
    """
    bad = (F.size(F.array_except(codes, F.array(*map(F.lit, harmless)))) > 0) | (outcomes != scheduled) | (item_failures > 0)
    return F.when(~bad, "succeeded").when(outcomes > 0, "partial").otherwise("failed")


def covered(boards: DataFrame, since: Column, last_at: str = "last_at", next_page: str = "next_page") -> Column:
    """Whether a board's pass since ``since`` is complete: done at or after it and back on page 1; null times are not."""
    return F.coalesce((F.col(last_at) >= since) & (F.col(next_page) == 1), F.lit(False))


def pass_coverage(boards: DataFrame, since: Column, last_at: str = "last_at", next_page: str = "next_page") -> DataFrame:
    """One row: total, completed, in_progress and pending boards, whether the pass is complete, and its progress signature."""
    counts = boards.agg(
        F.count("*").alias("total"), F.count_if(covered(boards, since, last_at, next_page)).alias("completed"),
        F.count_if(F.col(next_page) > 1).alias("in_progress"), F.coalesce(F.sum(next_page), F.lit(0)).alias("pages"),
    )
    pending = F.greatest(F.col("total") - F.col("completed") - F.col("in_progress"), F.lit(0))
    return counts.select("total", "completed", "in_progress", pending.alias("pending"), ((F.col("total") > 0) & (F.col("completed") == F.col("total"))).alias("complete"), "pages")


def board_order(last_at: str, next_page: str, board: str) -> list[Column]:
    """Sticky and fair: boards in progress first, the latest checkpoint before; then untouched and oldest ones."""
    going = F.col(next_page) > 1
    return [F.when(going, 0).otherwise(1), F.when(going, F.col(last_at)).desc_nulls_last(), F.when(~going, F.col(last_at)).asc_nulls_first(), F.col(board).asc()]


def move_anchors(boards: DataFrame, seen: DataFrame, board: str, anchor: str, ident: str) -> DataFrame:
    """Boards with their anchor moved to the largest id seen on them; boards of which none was seen keep theirs."""
    most = seen.groupBy(board).agg(F.max(ident).alias("_most"))
    return boards.join(most, board, "left").withColumn(anchor, F.coalesce("_most", anchor)).drop("_most")


def latest_event(runs: DataFrame, events: DataFrame, run: str, sequence: str, fields: list[str], counts: Column) -> DataFrame:
    """Each run with the fields of its last event for which ``counts`` holds (it may look at the run), nulls without one."""
    last = events.join(runs, run).filter(counts).groupBy(run).agg(F.max_by(F.struct(sequence, *fields), sequence).alias("_event"))
    return runs.join(last, run, "left").select(*runs.columns, *(F.col(f"_event.{f}").alias(f"event_{f}") for f in (sequence, *fields)))


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows behind the row with the values ``after``, in ``order`` of (column, descending); one to 50 rows.

    The last column must be unique; none of them may be null. The cursor of the next page
    are the values of the last row. One row more than asked for tells whether there is more:
    column has_more.
    """
    size = max(1, min(50, size))
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            behind = behind | (same & (F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value)))
            same = same & (F.col(name) == F.lit(value))
        rows = rows.filter(behind)
    sort = [F.col(name).desc() if descending else F.col(name).asc() for name, descending in order]
    page = rows.orderBy(*sort).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*sort))  # over at most 51 rows
    return page.withColumns({"_place": place, "_all": F.count("*").over(Window.partitionBy())}).filter(F.col("_place") <= size).withColumn("has_more", F.col("_all") > size).drop("_place", "_all")


def verified_view(items: DataFrame, publications: DataFrame, last_verified: DataFrame, key: str, sha: str) -> DataFrame:
    """Items whose published object is verified with the same hash, and for the others their last verified copy, if there is one."""
    good = items.join(publications.select(F.col("object_key").alias("_key"), F.col("object_sha").alias("_sha")), (F.concat(F.lit("published/"), F.col(key).cast("string")) == F.col("_key")) & (F.col(sha) == F.col("_sha"))).select(key, sha, F.lit("current").alias("copy"))
    rest = last_verified.join(good.select(key), key, "left_anti").select(key, sha, F.lit("last_verified").alias("copy"))
    return good.unionByName(rest)


def upload_plan(objects: DataFrame, attempts: DataFrame, key: str, imported_at: str) -> DataFrame:
    """(key, attempt, imported_at) per object; untried ones come first, then the earliest imported."""
    per = objects.groupBy(key).agg(F.min(imported_at).alias(imported_at))
    return per.join(attempts.select(key, "attempt"), key, "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))


def warning(codes: Column, ranked: dict[str, str]) -> Column:
    """The warning of the first code of ``ranked``, in its order, that is among ``codes``; else null."""
    return F.coalesce(*(F.when(F.array_contains(codes, code), text) for code, text in ranked.items()))


def safe_code(given: Column, fallback: Column) -> Column:
    """The given code, else the fallback; run_failed for anything but 1 to 128 letters, digits and ``_.:-``."""
    code = F.coalesce(F.nullif(given, F.lit("")), fallback)
    return F.when(F.regexp_like(code, F.lit(r"^[a-zA-Z0-9_.:-]{1,128}$")), code).otherwise("run_failed")


def merge_reports(reports: DataFrame, board: str, sequence: str, run: str, selected: Column) -> DataFrame:
    """Per board: its last report's sequence, the sum of each counter, all failure codes, and the last run that selected posts."""
    sums = reports.select(board, F.explode("counters").alias("name", "n")).groupBy(board, "name").agg(F.sum("n").alias("n"))
    sums = sums.groupBy(board).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counters"))  # a board has few counters
    facts = reports.groupBy(board).agg(F.max(sequence).alias("last"), F.sort_array(F.flatten(F.collect_set("codes"))).alias("_codes"), F.max_by(run, F.when(selected, F.col(sequence))).alias("selected_run"))
    return facts.join(sums, board, "left").select(board, "last", F.array_distinct("_codes").alias("codes"), "selected_run", "counters")


def spaced_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows at equal distances in order of ``key``: places round(i (n - 1) / (size - 1)), halves to even.

    Rows are numbered by ranges of the key, so no task numbers all of them, and rows of one
    key may go to several ranges. With ``size`` rows or fewer all are taken; of one the first.
    """
    with temporary(rows.sparkSession):
        placed = numbered_by_blocks(rows.withColumn("_tie", F.monotonically_increasing_id()), [], [F.col(key).asc_nulls_first(), F.col("_tie")], "sample")
        n = placed.count()
        size = min(size, n)
        places = sorted({round(i * (n - 1) / (size - 1)) if size > 1 else 0 for i in range(size)})
        return materialise(placed.filter(F.col("place").isin(places)).select(rows.columns), "sampled", keep=True)


def resume_scan(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows in order of ``key`` behind the last one read; the filter reaches the scan, nothing is skipped over."""
    rows = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def failure_timeline(runs: DataFrame, captures: DataFrame, run: str, finished: str, at: str, code: str, outcome: str, since: Column, removals: list[str]) -> DataFrame:
    """kind, day, code and n: error codes a day (kind error) and removal outcomes (kind removal, no day) of captures since ``since``.

    Only captures of runs that are open or ended since then count; the runs are chosen first, so that
    captures partitioned by run aren't read whole.
    """
    recent = runs.filter(F.col(finished).isNull() | (F.col(finished) >= since)).select(run)
    seen = captures.filter(F.col(at) >= since).join(recent, run, "left_semi")
    errors = F.struct(F.lit("error").alias("kind"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(code).alias("code"))
    gone = F.struct(F.lit("removal").alias("kind"), F.lit(None).cast("string").alias("day"), F.col(outcome).alias("code"))
    marks = F.array_compact(F.array(F.when(F.col(code).isNotNull(), errors), F.when(F.col(outcome).isin(removals), gone)))
    return seen.select(F.explode(marks).alias("m")).groupBy("m.kind", "m.day", "m.code").agg(F.count("*").alias("n"))
