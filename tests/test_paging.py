"""Pages against a plain loop."""

import numpy as np
import pytest

from folioflow.operators import paging
from folioflow.sources.shared import temporary


def looped(rows, items, room):
    out, lanes = [], {}
    for lane, key, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2] or 0)):
        page, slot, used = lanes.get(lane, (0, 0, 0))
        size = size or 0
        if slot and (slot == items or used + size > room):
            page, slot, used = page + 1, 0, 0
        out.append((lane, key, page, slot))
        lanes[lane] = (page, slot + 1, used + size)
    return sorted(out, key=str)


@pytest.mark.parametrize(("items", "room", "block", "fan"), [(5, 40, 7, 2), (50, 30, 60, 3), (500, 1 << 20, 50_000, 256)])
def test_pages_equal_those_of_a_loop(spark, items, room, block, fan):
    rng = np.random.default_rng(items)
    rows = [("hot", k, int(rng.integers(0, 20))) for k in range(700)] + [("long", k, 39) for k in range(33)] + [("one", 1, 10**7)]
    rows += [(None, k, None if k % 3 else 11) for k in range(40)] + [("big", k, 41 if k % 4 == 0 else 2) for k in range(50)] + [("hot", None, 3)]
    table = spark.createDataFrame(rows, "lane string, k long, size long").repartition(3)
    with temporary(spark):
        got = sorted(map(tuple, paging.pages(table, "lane", "k", "size", items=items, room=room, block=block, fan=fan).collect()), key=str)
    assert got == looped(rows, items, room)


def test_no_rows_and_repeated_rows(spark):
    with temporary(spark):
        assert paging.pages(spark.createDataFrame([], "lane string, k long, size long"), "lane", "k", "size").count() == 0
        same = spark.createDataFrame([("a", 1, 4)] * 30, "lane string, k long, size long")
        got = sorted((r.page, r.slot) for r in paging.pages(same, "lane", "k", "size", items=4, room=100, block=4).collect())
    assert got == [(k // 4, k % 4) for k in range(30)]
