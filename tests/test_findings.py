"""Cases that the reviews have found."""

from __future__ import annotations

import datetime
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow import catalogue
from folioflow.functions import bodies, hangul, listings
from folioflow.operators import merge, reading, works
from folioflow.plans import queries as _plans  # noqa: F401  registers the queries


def _column(spark, values, expr):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def _same_as_sql(spark, folder, name, table):
    """The rows of a query on the one table of a folder; its SQL gives the same."""
    columns = ", ".join(duckdb.sql(catalogue.ORACLES[name].replace(f"FROM {table}", f"FROM '{folder}/{table}.parquet'")).columns)
    sql = duckdb.sql(f"SELECT {columns} FROM ({catalogue.ORACLES[name].replace(f'FROM {table}', f'''FROM '{folder}/{table}.parquet' {table}''')})").fetchall()
    rows = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).select(*columns.split(", ")).collect()]
    assert sorted(rows, key=repr) == sorted(sql, key=repr)
    return rows


@pytest.mark.parametrize("name", ["a12_batches", "a12_items"])
def test_batches_whose_orders_share_six_digits(spark, tmp_path, name):
    """F1, F2"""
    duckdb.sql(f"COPY (SELECT key AS o_orderkey, 6::BIGINT AS o_custkey, 'O' AS o_orderstatus, '5-LOW' AS o_orderpriority FROM (VALUES (5::BIGINT), (1000005), (2000005), (7)) t(key)) TO '{tmp_path}/orders.parquet'")
    assert len(_same_as_sql(spark, tmp_path, name, "orders")) == (1 if name == "a12_batches" else 4)


def test_group_key_of_letters_with_long_capitals(spark):
    """F3"""
    assert _column(spark, ["ßa", "ǰ", "sa", "ſ"], hangul.group_key(F.col("v"))) == ["#", "#", "S", "S"]


def test_cover_initial_of_letters_with_long_capitals(spark):
    """F4"""
    assert _column(spark, ["ßa", "ŉ", "ᾳ", "[x] ß", "ﬁ", "é"], bodies.cover_initial(F.col("v"))) == ["ẞ", "ŉ", "ᾼ", "ẞ", "ﬁ", "É"]


def test_canonical_bodies_trim_what_the_sql_trims(spark, tmp_path):
    """F5"""
    texts = ["vab", "ab v", "\x0bab", "v", "vab\n", "vab\r\n", "ab\x0b\r\n", " ab\r\n", "ab\r\n", "", "ab v\r\n", "vv "]
    rows = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(texts * 3))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(doc_id, text)) TO '{tmp_path}/documents.parquet'")
    assert len(_same_as_sql(spark, tmp_path, "d20_canonical_bodies", "documents")) == 3 * len(texts)


def test_heat_at_a_limit_in_any_order(spark, tmp_path):
    """F6"""
    day = datetime.datetime(2024, 1, 1)
    for values in ([0.1] * 30, [1.1, 1.1, 0.8], [0.8, 1.1, 1.1], [0.16, 0.64, 0.98, 0.58, 0.61, 0.03], [0.7, 0.1, 2.2], [2.2, 0.7, 0.1]):
        spark.createDataFrame([(1, day, v) for v in values], "user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert [r.level for r in catalogue.QUERIES["j6_heat_levels"](spark, str(tmp_path)).collect()] == [1]
    rows = spark.createDataFrame([("a", 1.5), ("a", float("inf")), ("b", None), ("c", 1e300), ("d", 0.25), ("d", None)], "k string, v double")
    assert {r.k: r.s for r in rows.groupBy("k").agg(reading.decimal_sum(F.col("v")).alias("s")).collect()} == {"a": float("inf"), "b": None, "c": 1e300, "d": 0.25}


def test_replaced_children_are_not_sorted(spark):
    """F8"""
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    incoming = spark.createDataFrame([(1, "x"), (3, "y"), (2, "z"), (None, "w")], "k int, v string")
    rows = merge.replace_children(stored, incoming, spark.createDataFrame([(1,), (1,), (3,)], "k int"), "k")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, "x"), (2, "c"), (3, "y"), (None, "d")]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_names_read_the_head_of_a_text(spark):
    """F9"""
    odd = ["가".join("  \x1c"[i % 3] for i in range(900)), "ǘ" * 400, "e" + "́" * 3000 + "f" * 50, unicodedata.normalize("NFD", "각 ") * 500, " " * 5000 + "x" * 40, "😀" * 500, "가" * 600, "á̧ " * 500]
    whole = lambda t: " ".join(unicodedata.normalize("NFC", t).split()).encode("utf-16-le")[:60].decode("utf-16-le", "ignore") or None
    assert _column(spark, odd, bodies.clean_name(F.col("v"))) == [whole(t) for t in odd]
    assert max(_column(spark, ["word " * 100_000, "각" * 100_000], F.length(bodies.name_head(F.col("v"))))) <= 1024


def test_listings_are_parsed_once(spark):
    """F11"""
    rows = spark.range(1).select(listings.catalogue_page(F.col("id").cast("string")).alias("p")).select("p.fault", "p.total", F.get("p.works", F.lit(0))["title"].alias("title"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_chapters_of_both_sides_in_one_pass(spark):
    """F12"""
    schema = "work int, label string"
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None), (3, "a"), (4, "a"), (4, "a"), (None, "a")], schema)
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "a"), (4, "a"), (4, "a"), (5, "a"), (None, "a")], schema)
    rows = works.same_chapters(left, right, "work", "label")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, True, 2), (2, False, 1), (4, True, 0), (None, False, 0)]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
