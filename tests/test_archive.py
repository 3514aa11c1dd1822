"""Every archive query gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from folioflow import catalogue
from folioflow.plans import queries as _  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, expected)) == sorted(key(tuple(r)) for r in frame.select(columns).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
