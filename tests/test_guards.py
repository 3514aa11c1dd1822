"""Edge cases of references, guarded statuses, boundaries, retention and bins."""

import datetime
import random

from pyspark.sql import functions as F

from folioflow.functions import markup, threads, titles
from folioflow.operators import merge, queue, reading


def _column(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column.alias("x")).collect()]


def test_image_references(spark):
    pages = [None, "", "<img src=' '>", "<img src='http://[x/'><img src=a.png alt=''>", "<img src=//k/b SRC=c>"]
    found = _column(spark, pages, markup.image_references(F.col("v"), F.lit("https://h.org/d/e")))
    assert found[:3] == [[], [], []]
    assert [(i.position, i.resolved_url, i.alt) for i in found[3]] == [(2, "https://h.org/d/a.png", "")]
    assert [i.source_url for i in found[4]] == ["//k/b"]


def test_post_references_and_categories(spark):
    urls = ["https://h/aa_1/12", "https://h/aa/12/", "https://h/b?wr_id=5&bo_table=x", "https://h/b?bo_table=x", "", None]
    assert [r and tuple(r) for r in _column(spark, urls, markup.post_reference(F.col("v")))] == [("aa_1", 12), None, ("x", 5), None, None, None]
    assert _column(spark, ["[x]", "[ ]", " y ", "", None], markup.category(F.col("v"), F.lit("z"))) == ["x", None, "y", "z", "z"]


def test_series(spark):
    found = _column(spark, ["[AA] 제목 (12)", "제목12어장", "12", "[AA]", "", None], titles.series(F.col("v"), F.lit("a◆trip")))
    assert [(s.stem, s.tags) for s in found] == [("제목", "[AA]"), ("제목", ""), ("12", ""), ("[AA]", "[AA]"), ("", ""), ("", "")]
    assert found[0].key == found[1].key and len(found[0].key) == 16
    assert _column(spark, ["ｘ 1"], titles.series(F.col("v"), F.lit("trip"))["key"]) == _column(spark, ["X 2"], titles.series(F.col("v"), F.lit("b◆trip"))["key"])


def test_guarded_status(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    schema = "k string, seen timestamp, outcome string, note string"
    stored = spark.createDataFrame([("a", day(5), "x", "n"), ("b", day(30), "x", "n"), ("c", None, "x", None), ("d", day(5), "x", None)], schema)
    reports = spark.createDataFrame(
        [("a", day(5), "y", None, 1), ("a", day(4), "z", "m", 2), ("b", day(1), "y", None, 1), ("c", day(1), "y", "m", 1), ("d", day(30), "y", None, 1), ("d", None, "z", None, 2), ("e", day(2), "y", None, 1)], schema + ", n int"
    )
    done = merge.guarded_status(stored, reports, "k", "seen", "n", ["note"], F.lit("2024-01-10").cast("timestamp")).orderBy("k").collect()
    assert [(r.k, r.seen.day, r.outcome, r.note) for r in done] == [("a", 5, "y", "n"), ("b", 1, "y", "n"), ("c", 1, "y", "m"), ("d", 5, "x", None), ("e", 2, "y", None)]
    assert merge.guarded_status(stored.limit(0), reports.limit(0), "k", "seen", "n", ["note"], F.current_timestamp()).count() == 0


def test_legacy_comments(spark):
    rows = spark.createDataFrame([(1, 30, 10, "c"), (1, 10, None, None), (1, 20, 99, "b"), (2, 10, 30, " ")], "p int, id int, parent int, t string")
    done = threads.legacy_comments(rows, ["p"], "id", "parent", "t", "-").orderBy("p", "position").collect()
    assert [(r.p, r.position, r.parent_position, r.t) for r in done] == [(1, 1, None, "-"), (1, 2, None, "b"), (1, 3, 1, "c"), (2, 1, None, "-")]


def test_pruned_files(spark):
    now = datetime.datetime(2024, 1, 10)
    rows = spark.createDataFrame([("k", i, 10, now - datetime.timedelta(days=i)) for i in range(8)], "k string, id int, size int, made timestamp")
    drop = lambda *a: sorted(r.id for r in queue.pruned_files(rows, ["k"], "made", "size", "id", F.lit(now), *a).collect())
    assert drop(5 * 86_400, 1000) == [6, 7] and drop(100 * 86_400, 30) == [3, 4, 5, 6, 7] and drop(0, 0, 2 * 86_400) == [2, 3, 4, 5, 6, 7]


def _edges(weights, bins):
    """Bins entry by entry, as one would fold them."""
    count, total = len(weights), sum(weights)
    ends = [sum(weights[: i + 1]) for i in range(count)]
    edges, index = [0], 0
    for b in range(1, bins):
        while index < count and ends[index] * bins <= total * b:
            index += 1
        edges.append(min(max(index, edges[-1] + 1), count - (bins - b)))
    return [sum(e <= n for e in edges) - 1 for n in range(count)]


def test_length_bins(spark):
    random.seed(5)
    works = {w: [random.choice((1, 1, 2, 90)) for _ in range(random.randint(1, 30))] for w in range(40)}
    rows = spark.createDataFrame([(w, i, x, 0) for w, ws in works.items() for i, x in enumerate(ws)], "work int, position int, x int, state int")
    done = {(r.work, r.bin): (r.n, r.length) for r in reading.length_bins(rows, "work", "position", F.col("x"), F.col("state"), 7).collect()}
    wanted = {}
    for w, ws in works.items():
        for x, b in zip(ws, _edges(ws, min(7, len(ws)))):
            n, length = wanted.get((w, b), (0, 0))
            wanted[w, b] = (n + 1, length + x)
    assert done == wanted
    assert reading.length_bins(rows.limit(0), "work", "position", F.col("x"), F.col("state"), 7).count() == 0


def test_discovery_picks(spark):
    works = spark.createDataFrame([(i, "oneshot" if i < 5 else "series", 2 if i < 10 else 3, i * 1000, None) for i in range(40)], "w int, kind string, available int, views int, comments int")
    begun = spark.createDataFrame([(i,) for i in range(10, 20)], "w int")
    draw = lambda *a: [r.w for r in reading.discovery_picks(works, begun, "w", *a).collect()]
    assert draw("2024-01-01") == draw("2024-01-01") and all(w >= 20 for w in draw("2024-01-01")) and len(draw("2024-01-01", 0, 3)) == 3
    assert len({tuple(draw("2024-01-01", n)) for n in range(4)}) > 1
