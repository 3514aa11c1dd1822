"""Edge cases of search copies, locators, quotes, outboxes, collectors and unchanged lanes."""

from pyspark.sql import functions as F

from folioflow.functions import places
from folioflow.operators import queue, release, works


def test_search_copy():
    assert places.copy_of("") == ("", [], [])
    text, starts, ends = places.copy_of("á \n ﬁΣ")
    assert text == "á fiς" and starts == [0, 2, 5, 5, 6] and ends == [2, 5, 6, 6, 7]


def test_null_texts(spark):
    rows = spark.createDataFrame([(None,), ("",)], "v string")
    assert [tuple(r[0]) for r in rows.select(places.search_copy("v")).collect()] == [("", [], []), ("", [], [])]
    assert rows.select(places.source_range(places.search_copy("v"), F.lit(0), F.lit(1)).alias("r")).collect()[0].r is None


def test_locators(spark):
    place = lambda text, start, stop, rev="a": dict(zip(("rev", "start", "stop", "exact", "prefix", "suffix"), (rev, start, stop, text[start:stop], text[max(0, start - 32) : start], text[stop : stop + 32])))
    text = "one two one two one"
    assert places.found_place(text, "a", place(text, 8, 11)) == ("exact", 8, 11)
    assert places.found_place("x" + text, "b", place(text, 8, 11)) == ("candidate", 9, 12)
    assert places.found_place("-one-one-", "b", {"rev": "a", "start": 3, "stop": 6, "exact": "one", "prefix": "", "suffix": ""}) == ("unresolved", None, None)
    assert places.found_place("none here", "b", place("word", 0, 4))[0] == "unresolved" and places.found_place("abc", "b", place("abc", 1, 1))[0] == "unresolved"
    rows = spark.createDataFrame([(text, "a"), (None, "a")], "t string, r string")
    got = rows.select(places.resolved_locator("t", "r", places.locator(F.lit(text), F.lit(8), F.lit(99), F.lit("a"))).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [("exact", 8, 19), ("unresolved", None, None)]


def test_quotes(spark):
    rows = spark.createDataFrame([("A. b ", "c", " d"), ("A.\n", "c", None), (None, " ", "d"), ("x", "y" * 200, "")], "prefix string, exact string, suffix string")
    assert [r[0] for r in rows.select(places.last_quote(F.struct("*"))).collect()] == ["b c d", "c", "", "y" * 120]


def test_outbox(spark):
    rows = spark.createDataFrame([("l", 1, 10, 5), ("l", 2, 10, 1), ("l", 3, 10, 1), ("l", 4, 10, 100), ("m", 5, 10, 1)], "lane string, id int, size int, rank int")
    room = spark.createDataFrame([("l", 15, 5), ("m", 11, 5)], "lane string, needed int, priority int")
    assert sorted(r.id for r in queue.evicted(rows, room, "id", "size", "rank").collect()) == [2, 3]
    assert queue.evicted(rows.limit(0), room, "id", "size", "rank").count() == 0
    due = spark.createDataFrame([(1, None), (2, 5), (3, 50), (4, 1)], "id int, due int")
    assert sorted(r.id for r in queue.head_of_line(due, F.lit(9), "id", "due").collect()) == [1, 2]
    assert queue.head_of_line(due, F.lit(99), "id", "due").count() == 4


def test_next_unit(spark):
    rows = spark.createDataFrame([("a", "work", "1", "pending", 0, 1), ("b", "episode", "2", "retry", 0, 9), ("a", "episode", "3", "done", 0, 0)], "source string, kind string, entity string, status string, next_check_at int, updated_at int")
    lists = spark.createDataFrame([("a", 4, 0), ("b", 5, 99)], "source string, next_page int, next_check_at int")
    cool = spark.createDataFrame([("a", 50)], "source string, cooldown_until int")
    unit = lambda now, served, *more: [tuple(r) for r in queue.next_unit(rows, lists, cool, F.lit(now), served, *more).collect()]
    assert unit(60, 0, "b", None) == [("a", "list", "4")] and unit(60, 3, "a", None) == [("a", "work", "1")]
    assert unit(9, 2, "b", "both") == [("b", "episode", "2")] and unit(9, 2, "b", "a") == [] and unit(99, 1, "a", None) == [("b", "list", "5")]


def test_lanes_and_links(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "lane string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), (None, 3)], "lane string, v int")
    assert {r.lane: r.unchanged for r in release.unchanged_lanes(rows, after, "lane", "v").collect()} == {"a": False, "b": True, "c": False, None: True}
    links = spark.createDataFrame([("b", "a", True), ("a", "c", True), ("a", "d", False)], "l string, r string, certain boolean")
    said = spark.createDataFrame([("c", "a", 1, "reject"), ("a", "d", 1, "reject"), ("d", "a", 2, "accept"), ("x", "y", 1, "accept")], "l string, r string, n int, decision string")
    assert sorted(map(tuple, works.reviewed_links(links, said, "l", "r", "n").collect())) == [("a", "b"), ("a", "d"), ("x", "y")]
