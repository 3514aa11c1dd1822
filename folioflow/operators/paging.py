"""Pages of a count or a size, whichever is full first, cut one after the other over very long lists.

Where a page begins depends on all pages before it. A list is cut into blocks of rows.
For each of the few places at which a page may first begin in a block, the block tells
where the first page behind it begins; such maps are joined two by two, and then handed
down again, so no task ever holds a whole list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.shared import materialise, shuffle_partitions, temporary


def numbered_by_blocks(rows: DataFrame, keys: list[str], order: list[Column], tag: str = "numbered") -> DataFrame:
    """Adds place, from 0, in ``order`` within each key.

    Rows are sorted by ranges of key and order, and each range is numbered on its own; only
    counts per key and range meet. So a key may hold any share of all rows.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *(F.col(k).asc_nulls_first() for k in keys), *order)
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()), tag)
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_nth", nth).join(counts, same).withColumn("place", (F.col("_before") + F.col("_nth")).cast("long")).drop("_range", "_r", "_nth", "_before", *(f"_{k}" for k in keys))


def following(sizes: np.ndarray, items: int, room: int) -> np.ndarray:
    """For each item the place at which the page after one that begins with it begins.

    A page ends with its ``items``-th item or before the item that would take it beyond
    ``room``. An item that alone is larger has a page of its own.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.searchsorted(total, total[:-1] + room, "right") - 1
    first = np.arange(len(sizes))
    return np.maximum(first + 1, np.minimum(by_size, first + items))


def _lane_columns(lane: str, kind: str, *more: str) -> str:
    return ", ".join([f"{lane} {kind}", *more])


def pages(rows: DataFrame, lane: str, key: str, size: str, *, items: int = 500, room: int = 1 << 20, block: int = 50_000, fan: int = 256) -> DataFrame:
    """(lane, key, page, slot): every row's page within its lane, from 0, and its place in that page.

    A lane's rows are taken in order of ``key`` (nulls first). A page has at most ``items``
    rows and, by ``size``, at most ``room``; a row that alone is larger has a page of its
    own. Sizes are not negative; a null size is 0 and a null lane is a lane. Rows of one key
    are in any order among themselves. An empty table gives no rows. The tables that are made on the way are in the
    shared folder; the result stays there until the caller's ``temporary`` block ends.
    """
    spark = rows.sparkSession
    kind = rows.schema[lane].dataType.simpleString()
    block = max(block, items)  # then the first page behind a block begins in the next one
    with temporary(spark):
        taken = rows.select(lane, key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
        placed = numbered_by_blocks(taken, [lane], [F.col(key).asc_nulls_first(), F.col("_size")], "page-rows")
        placed = materialise(placed.withColumn("_block", F.floor(F.col("place") / block)), "page-places")

        # The first rows of the next block tell where the last pages of a block end.
        early = placed.filter((F.col("_block") > 0) & (F.col("place") % block < items)).withColumn("_block", F.col("_block") - 1)
        around = placed.unionByName(early).select(lane, "place", "_size", "_block")

        def block_map(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place")
            number = int(group["_block"].iloc[0])
            own = int((group["place"] // block == number).sum())
            after = following(group["_size"].to_numpy(), items, room)
            out, count = np.zeros(own, np.int64), np.zeros(own, np.int64)
            for k in range(own - 1, -1, -1):
                inside = after[k] < own
                out[k] = out[after[k]] if inside else after[k] - own
                count[k] = 1 + (count[after[k]] if inside else 0)
            width = min(items, own)
            return pd.DataFrame({lane: [group[lane].iloc[0]], "_block": [number], "exits": [out[:width].tolist()], "counts": [count[:width].tolist()]})

        maps = [materialise(around.groupBy(lane, "_block").applyInPandas(block_map, _lane_columns(lane, kind, "_block long", "exits array<long>", "counts array<long>")), "page-maps")]

        def joined(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_block")
            exits, counts = (np.array(group[c].iloc[0]) for c in ("exits", "counts"))
            for more, n in zip(group["exits"].iloc[1:], group["counts"].iloc[1:], strict=True):
                more, n = np.array(more), np.array(n)
                reached = exits < len(more)  # a list's last block may be shorter than the place where a page would begin
                at = np.minimum(exits, len(more) - 1)
                counts = counts + np.where(reached, n[at], 0)
                exits = np.where(reached, more[at], exits - len(more))
            return pd.DataFrame({lane: [group[lane].iloc[0]], "_block": [int(group["_block"].iloc[0]) // fan], "exits": [exits.tolist()], "counts": [counts.tolist()]})

        while maps[-1].filter("_block > 0").limit(1).count():
            above = maps[-1].withColumn("_above", F.floor(F.col("_block") / fan)).groupBy(lane, "_above")
            maps.append(materialise(above.applyInPandas(joined, _lane_columns(lane, kind, "_block long", "exits array<long>", "counts array<long>")), "page-maps"))

        # From the top down: where the first page of each block begins, and how many pages are before it.
        begins = maps[-1].select(lane, "_block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))

        def handed_down(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_block")
            entry, before = int(group["entry"].iloc[0]), int(group["before"].iloc[0])
            found = []
            for number, exits, counts in zip(group["_block"], group["exits"], group["counts"], strict=True):
                found.append((group[lane].iloc[0], int(number), entry, before))
                entry, before = (int(exits[entry]), before + int(counts[entry])) if entry < len(exits) else (entry - len(exits), before)
            return pd.DataFrame(found, columns=[lane, "_block", "entry", "before"])

        for level in reversed(maps[:-1]):
            top = begins.select(F.col(lane).alias("_lane"), F.col("_block").alias("_above"), "entry", "before")
            down = level.withColumn("_in", F.floor(F.col("_block") / fan)).join(top, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("_in") == F.col("_above")))
            begins = materialise(down.groupBy("_lane", "_above").applyInPandas(handed_down, _lane_columns(lane, kind, "_block long", "entry long", "before long")), "page-begins")

        def cut(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place").reset_index(drop=True)
            after = following(group["_size"].to_numpy(), items, room)
            at, starts = int(group["entry"].iloc[0]), []
            while at < len(group):
                starts.append(at)
                at = int(after[at])
            first = np.zeros(len(group), np.int64)
            first[starts] = 1
            page = np.cumsum(first) - 1  # -1: the page that began in the block before
            place = group["place"].to_numpy()
            slot = place - np.where(page >= 0, place[np.array([*starts, 0])[page]], 0)
            return pd.DataFrame({lane: group[lane], key: group[key], "place": place, "page": page + group["before"], "slot": np.where(page >= 0, slot, -1)})

        entries = begins.select(F.col(lane).alias("_lane"), F.col("_block").alias("_b"), "entry", "before")
        shown = placed.join(entries, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("_block") == F.col("_b"))).drop("_lane", "_b")
        key_kind = rows.schema[key].dataType.simpleString()
        found = materialise(shown.groupBy(lane, "_block").applyInPandas(cut, _lane_columns(lane, kind, f"{key} {key_kind}", "place long", "page long", "slot long")), "page-slots")
        # Rows before a block's first page belong to a page of fewer than ``items`` rows of the block before.
        begun = found.filter("slot = 0").select(F.col(lane).alias("_lane"), F.col("page").alias("_page"), F.col("place").alias("_start"))
        left = found.filter("slot < 0").join(begun, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("page") == F.col("_page")))
        left = left.withColumn("slot", F.col("place") - F.col("_start")).drop("_lane", "_page", "_start")
        return materialise(found.filter("slot >= 0").unionByName(left).drop("place"), "pages", keep=True)
