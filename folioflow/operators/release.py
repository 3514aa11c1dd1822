"""Catalogue and release projections: hashes, change sets, deltas, reachability and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.paging import numbered_by_blocks


def row_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as text; a null differs from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields)), 256)


def change_set(old: DataFrame, new: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, change) of the rows that were added, removed or changed between two projections."""
    left, right = old.select(key, F.col(sha).alias("_old")), new.select(key, F.col(sha).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return left.join(right, key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, change.alias("change"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Each parent with the array of its children in ``order``; the array is empty where there are none."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))
    empty = F.array().cast(grouped.schema[name].dataType)
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, empty))


def publish_delta(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Objects that the current release reaches and the previous one did not."""
    return current.select(key).distinct().join(previous.select(key).distinct(), key, "left_anti")


def garbage(objects: DataFrame, releases: list[DataFrame], key: str, old_enough: Column) -> DataFrame:
    """Objects that no kept release reaches and that are old enough; without a kept release nothing is garbage."""
    if not releases:
        return objects.filter(F.lit(False))
    reachable = releases[0].select(key)
    for release in releases[1:]:
        reachable = reachable.unionByName(release.select(key))
    return objects.filter(old_enough).join(reachable.distinct(), key, "left_anti")


def fingerprint(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """Count and order-free hash of the rows per key: a sum, so repeated rows count; equal tables give equal fingerprints."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).alias("fingerprint"))


def entry_view(entries: DataFrame, posts: DataFrame, collection: str, position: str, post: str) -> DataFrame:
    """Collection entries with the state of their posts (missing where there is no post) and whether positions run 1..n."""
    found = posts.select(post, F.lit("available").alias("_state"))
    rows = entries.join(found, post, "left").withColumn("availability", F.coalesce("_state", F.lit("missing"))).drop("_state")
    whole = entries.groupBy(collection).agg(((F.max(position) == F.count("*")) & (F.min(position) == 1) & (F.count_distinct(position) == F.count("*"))).alias("contiguous"))
    return rows.join(whole, collection)


def text_pages(items: DataFrame, keys: list[str], order: list[Column], per_page: int, sha: str) -> DataFrame:
    """Pages of ``per_page`` items in order, each with its hash over the items' hashes."""
    rows = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("page", F.floor(F.col("_n") / per_page))
    packed = rows.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(F.struct("_n", sha))).alias("_items"))
    return packed.select(*keys, "page", F.size("_items").cast("long").alias("n"), F.sha2(F.array_join(F.col(f"_items.{sha}"), "\n"), 256).alias("page_sha256"))


def post_documents(posts: DataFrame, comments: DataFrame, key: str, position: str, fields: list[str], comment_fields: list[str]) -> DataFrame:
    """(key, payload, payload_sha256, object_key): each post as JSON, its fields and comments in order, nulls kept.

    A post's comments are gathered in one row; a post is expected to have no more than fit there.
    """
    whole = nested(posts.select(key, *fields), comments, key, position, comment_fields, "comments")
    payload = F.concat(F.to_json(F.struct(*sorted(fields), "comments"), {"ignoreNullFields": "false"}), F.lit("\n"))
    rows = whole.select(key, payload.alias("payload")).withColumn("payload_sha256", F.sha2("payload", 256))
    return rows.withColumn("object_key", F.concat(F.lit("posts/"), F.col(key).cast("string"), F.lit("-"), F.col("payload_sha256"), F.lit(".json")))


def release_tables(posts: DataFrame, board: str, key: str, sha: str) -> DataFrame:
    """(board, n, board_sha256) of a full release: each board's posts counted, and a hash of all their hashes in any order."""
    return posts.groupBy(board).agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, sha).cast("decimal(38,0)")).cast("string").alias("board_sum"))


def validate(search: DataFrame, boards: DataFrame, entries: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(check, faults) of a release: posts of the search index and of the boards are the same set, no post stands in two

    collections, positions are 1 to n, each collection's total is its number of entries. All 0 for a valid release.
    """
    both = search.select(key, F.lit(1).alias("_n")).unionAll(boards.select(key, F.lit(-1).alias("_n")))
    only = both.groupBy(key).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("search_is_boards"))
    twice = entries.groupBy(key).agg((F.min("collection") != F.max("collection")).alias("_twice")).agg(F.count_if("_twice").alias("one_collection"))
    facts = entries.groupBy("collection", "position").agg(F.count("*").alias("_n"))
    facts = facts.groupBy("collection").agg(F.sum("_n").alias("_n"), F.min("position").alias("_low"), F.max("position").alias("_high"), F.count("position").alias("_d"))
    met = totals.select("collection", F.col("n").alias("_total")).join(facts, "collection", "full")
    gap = F.col("_n").isNotNull() & ((F.col("_low") != 1) | (F.col("_high") != F.col("_n")) | (F.col("_d") != F.col("_n")))
    wrong = F.coalesce("_total", F.lit(0)) != F.coalesce("_n", F.lit(0))
    counts = met.agg(F.count_if(gap).alias("contiguous"), F.count_if(wrong).alias("totals"))
    rows = [part.unpivot([], names, "check", "faults") for part, names in ((only, ["search_is_boards"]), (twice, ["one_collection"]), (counts, ["contiguous", "totals"]))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def release_mode(known: bool, schema_changed: bool, changed: int, collections_changed: bool, limit: int = 5000) -> str:
    """full without a previous release or with another schema, bootstrap_required beyond ``limit`` changes, else delta, collections or none."""
    if not known or schema_changed:
        return "full"
    if changed > limit:
        return "bootstrap_required"
    return "delta" if changed else "collections" if collections_changed else "none"


def retained(releases: DataFrame, active: Column, at: str, newest: int, younger_than: Column) -> DataFrame:
    """Releases to keep: the active one, the ``newest`` ones and those younger than a time."""
    rank = F.row_number().over(Window.orderBy(F.desc(at)))  # releases are few
    return releases.withColumn("_rank", rank).filter(active | (F.col("_rank") <= newest) | (F.col(at) > younger_than)).drop("_rank")


def finalise_receipts(receipts: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Receipts of revision 1 whose objects are published become revision 2."""
    done = published.select(key).distinct().withColumn("_done", F.lit(True))
    rows = receipts.join(done, key, "left")
    return rows.withColumn("revision", F.when((F.col("revision") == 1) & F.coalesce("_done", F.lit(False)), 2).otherwise(F.col("revision"))).drop("_done")


def incremental_mode(base: dict[str, Column], now: dict[str, Column], changed: Column, limit: int = 5000) -> Column:
    """What an incremental export does, or the fault that stops it.

    Both sides give source, water (the last capture), projection, posts, content and collections
    (fingerprints). Modes are noop, collections and delta; faults source_changed,
    source_rewound, projection_untracked (a change that no capture explains) and
    delta_too_large (``limit`` 0: none).
    """
    same = lambda name: base[name].eqNullSafe(now[name])
    untracked = ~same("projection") & same("posts") & (changed == 0)
    large = (F.lit(limit) > 0) & (changed > limit)
    return (
        F.when(~same("source"), "source_changed").when(now["water"] < base["water"], "source_rewound").when(same("content") & same("collections"), "noop").when(same("content"), "collections")
        .when(untracked, "projection_untracked").when(large, "delta_too_large").otherwise("delta")
    )


def unchanged_lanes(before: DataFrame, after: DataFrame, lane: str, *fields: str) -> DataFrame:
    """lane and unchanged: whether the rows of a lane are those of its last build, so that it needn't be built (a lane that left or came has changed)."""
    sides = [fingerprint(rows, [lane], *fields).select(lane, F.struct("n", "fingerprint").alias("_print"), F.lit(side).alias("_side")) for side, rows in enumerate((before, after))]
    prints = sides[0].unionByName(sides[1]).groupBy(lane).agg(*(F.max_by("_print", F.when(F.col("_side") == side, 1)).alias(name) for side, name in enumerate(("_old", "_new"))))
    return prints.select(lane, F.col("_old").eqNullSafe(F.col("_new")).alias("unchanged"))


def ordered_fingerprint(rows: DataFrame, lane: str, order: list[Column], *fields: str) -> DataFrame:
    """(lane, n, fingerprint) over a lane's rows in order: rows that swap their places change it, files and partitions don't.

    Each row is hashed with its place; hashes are summed, so lanes of any length are split
    over tasks. Rows that tie in ``order`` must be equal. Null lanes are a lane.
    """
    placed = numbered_by_blocks(rows, [lane], order, "fingerprint")
    told = F.concat_ws("\x1f", F.col("place").cast("string"), *(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in fields))
    number = F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("decimal(38,0)")
    return placed.groupBy(lane).agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("fingerprint"))
