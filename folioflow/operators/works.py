"""Works: grouping of documents, copies across sources, links between works and chapter order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.shared import materialise, temporary


def preview(posts: DataFrame, block: list[str], base: Column, order: Column, tie: str, shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Proposed works and the count of each reason for which a post is in none.

    Posts are blocked by ``block`` and base title. An episode that stands twice in a block
    drops out, and a block needs two episodes or more.
    """
    rows = posts.withColumns({"base": base, "episode": order})
    reason = F.when(F.col("episode").isNull(), "no_episode").when(F.length("base") < shortest, "short_title")
    rows = rows.withColumn("reason", reason)
    # Counts are aggregated before they meet the rows, so a frequent title is never gathered.
    fine = rows.filter("reason IS NULL")
    keys = [*block, "base"]
    episodes = fine.groupBy(*keys, "episode").agg(F.count("*").alias("_copies"))
    sizes = episodes.filter("_copies = 1").groupBy(*keys).agg(F.count("*").alias("_size"))
    counts = episodes.join(sizes, keys, "left").select(*(F.col(k).alias(f"_{k}") for k in [*keys, "episode"]), "_copies", F.coalesce("_size", F.lit(0)).alias("_size"))
    same = F.lit(True)
    for k in [*keys, "episode"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.join(counts, same, "left")
    reason = F.coalesce("reason", F.when(F.col("_copies") > 1, "repeated_episode").when(F.col("_size") < 2, "single"))
    rows = rows.withColumn("reason", reason).drop(*counts.columns)
    place = F.row_number().over(Window.partitionBy(*block, "base").orderBy("episode", tie))
    return rows.filter("reason IS NULL").drop("reason").withColumn("position", place), rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def pair_copies(chapters: DataFrame, keys: list[str], sha: str, site: str, order: list[str], ident: str) -> DataFrame:
    """Chapters with the copies on other sites folded in: the k-th copy of a site pairs with the k-th of the others.

    The earliest copy represents each group; texts on a single site stay apart.
    """
    copy = F.row_number().over(Window.partitionBy(*keys, sha, site).orderBy(*order, ident))
    rows = chapters.withColumn("copy", copy)
    return rows.groupBy(*keys, sha, "copy").agg(F.min_by(ident, F.struct(*order, ident)).alias("representative"), F.count("*").alias("variants"))


def link_basis(chapters: DataFrame, work: str, site: str, chapter_key: str, sha: str, least: int = 2) -> DataFrame:
    """Pairs of works on different sites that share at least ``least`` texts under equal chapter keys.

    A (chapter, text) that stands in many works of one site says nothing about any of
    them, so only those that are unique on both sites count.
    """
    marks = chapters.groupBy(site, chapter_key, sha).agg(F.min(work).alias("work"), F.count_distinct(work).alias("_works")).filter("_works = 1")
    left = marks.select(chapter_key, sha, F.col(site).alias("_ls"), F.col("work").alias("left_work"))
    right = marks.select(chapter_key, sha, F.col(site).alias("_rs"), F.col("work").alias("right_work"))
    shared = left.join(right, [chapter_key, sha]).filter("_ls < _rs")
    return shared.groupBy("left_work", "right_work").agg(F.count_distinct(sha).alias("shared")).filter(F.col("shared") >= least)


def merge_links(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, canonical) of every linked work; canonical is the least id that its links reach.

    Each round takes the least label around a node and then follows labels of labels, until
    no label changes. Rounds are tables in the folder of ``spark.checkpoint.dir``, so lost
    executors cost one round at most; they are removed at the end, but for the result.
    """
    with temporary(links.sparkSession):
        both = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
        both = materialise(both.union(both.select("b", "a")).distinct(), "links")
        labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("canonical")), "labels")
        changed = True
        while changed:
            around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("canonical").alias("_near"))
            near = labels.join(around, "id").select("id", "canonical", F.least("canonical", "_near").alias("_next"))
            jump = labels.select(F.col("id").alias("_next"), F.col("canonical").alias("_far"))
            moved = materialise(near.join(jump, "_next", "left").select("id", F.least("_next", "_far").alias("_to"), "canonical"), "labels")
            changed = moved.filter("_to <> canonical").limit(1).count() > 0
            labels = moved.select("id", F.col("_to").alias("canonical"))
        return materialise(labels, "canonical", keep=True)


def chapter_order(chapters: DataFrame, work: str, site: str, group: str, source_position: str, parsed: list[Column]) -> DataFrame:
    """Adds place (from 1): by source position where a work has one site, one group and distinct positions, else by parsed keys."""
    over = Window.partitionBy(work)
    twice = F.lag(source_position).over(over.orderBy(source_position)) == F.col(source_position)
    one = lambda c: F.min(c).over(over).eqNullSafe(F.max(c).over(over)) & (F.count(c).over(over) > 0)
    rows = chapters.withColumn("_twice", F.coalesce(twice, F.lit(False)))
    rows = rows.withColumn("by_source", one(site) & one(group) & (F.count(source_position).over(over) == F.count("*").over(over)) & ~F.max("_twice").over(over)).drop("_twice")
    own = F.when(F.col("by_source"), F.col(source_position))
    return rows.withColumn("place", F.row_number().over(over.orderBy(own, *parsed)))


def latest_label(chapters: DataFrame, work: str, place: str, label: str, numbered: Column) -> DataFrame:
    """The label of the last numbered chapter, else of the last one."""
    return chapters.groupBy(work).agg(F.coalesce(F.max_by(label, F.when(numbered, F.col(place))), F.max_by(label, place)).alias("latest_label"))


def reconcile(groups: DataFrame, entries: DataFrame, board: str, group: str, post: str, order: str, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a proposed group means for existing collections: (group, verdict, collection), and the posts to append.

    ``groups`` has a row per post of a group, with its order, author, title and available;
    ``entries`` the collection, position and post of existing entries, ``titles`` the titles
    in use per board. Verdicts, of which the first holds: unknown_author; without a member in
    any collection new_collection_conflict (the title is taken or a post is not available)
    or new_collection; ambiguous_or_unanchored (several collections, or fewer than two
    members); last_entry_not_anchor (the collection ends with another post than the group's
    last member); else append: available posts behind the last member that are in no collection.
    """
    last = entries.groupBy("collection").agg(F.max_by(post, "position").alias("_last_entry"))
    member = entries.select(post, "collection").distinct()
    rows = groups.join(member, post, "left")
    facts = rows.groupBy(board, group).agg(
        F.bool_or(F.coalesce(F.trim("author"), F.lit("")) == "").alias("_unknown"), F.bool_and("available").alias("_available"), F.count_distinct("collection").alias("_collections"),
        F.count("collection").alias("_members"), F.first("collection", ignorenulls=True).alias("collection"), F.max(F.when(F.col("collection").isNotNull(), F.struct(order, post))).alias("_anchor"), F.min("title").alias("title"),
    )
    taken = titles.select(board, "title").distinct().withColumn("_taken", F.lit(True))
    facts = facts.join(last, "collection", "left").join(taken, [board, "title"], "left")
    verdict = (
        F.when(F.col("_unknown"), "unknown_author").when((F.col("_collections") == 0) & (F.coalesce("_taken", F.lit(False)) | ~F.col("_available")), "new_collection_conflict")
        .when(F.col("_collections") == 0, "new_collection").when((F.col("_collections") != 1) | (F.col("_members") < 2), "ambiguous_or_unanchored")
        .when(~F.col("_last_entry").eqNullSafe(F.col(f"_anchor.{post}")), "last_entry_not_anchor").otherwise("append")
    )
    facts = facts.withColumn("verdict", verdict)
    behind = rows.join(facts.filter("verdict = 'append'").select(board, group, F.col("collection").alias("_to"), F.col(f"_anchor.{order}").alias("_after")), [board, group])
    appended = behind.filter(F.col("collection").isNull() & F.col("available") & (F.col(order) > F.col("_after"))).select(F.col("_to").alias("collection"), post, order)
    return facts.select(board, group, "verdict", F.when(F.col("verdict") == "append", F.col("collection")).alias("collection")), appended


def aliases(history: DataFrame, old: str, new: str, at: str) -> DataFrame:
    """(alias, canonical) of renamed works: the last name of each, chains followed to their end by ``merge_links`` of the names."""
    last = history.groupBy(old).agg(F.max_by(new, at).alias("_to")).filter(F.col(old) != F.col("_to"))
    ends = last.join(last.select(F.col(old).alias("_again")), F.col("_to") == F.col("_again"), "left_anti").select(F.col("_to").alias("end")).distinct()
    groups = merge_links(last, old, "_to")
    named = groups.join(ends, F.col("id") == F.col("end")).groupBy(F.col("canonical").alias("_c")).agg(F.max("end").alias("end"))
    return groups.join(named, F.col("canonical") == F.col("_c")).filter("id <> end").select(F.col("id").alias("alias"), F.col("end").alias("canonical"))


def thread_works(threads: DataFrame, segments: DataFrame, key: str, thread: str, at: str, segment: str) -> DataFrame:
    """Chapters of works made of threads: place by the thread's date, its id and the segment; the newest thread names the work."""
    facts = threads.groupBy(key).agg(F.max_by("title", F.struct(at, thread)).alias("work_title"), F.count_distinct(thread).alias("threads"))
    rows = segments.join(threads.select(thread, key, at), thread).join(facts, key)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at, thread, segment)))


def pinned_key(rule: Column, pin: Column) -> Column:
    """A hand-set key before that of the rule."""
    return F.coalesce(pin, rule)


def same_chapters(left: DataFrame, right: DataFrame, work: str, label: str) -> DataFrame:
    """(work, equal, shared) of works on both sides: whether their labels are the same multiset, and how many labels are unique on both."""
    unknown = F.col(work).isNull() | F.col(label).isNull()  # a null is no other side's null
    side = lambda rows, a: rows.select(work, label, F.lit(a).alias("_left"), F.when(unknown, a).alias("_alone"))
    counts = side(left, True).unionAll(side(right, False)).groupBy(work, label, "_alone").agg(F.count_if("_left").alias("_a"), F.count_if(~F.col("_left")).alias("_b"))
    facts = counts.groupBy(work).agg(F.bool_and(F.col("_a") == F.col("_b")).alias("equal"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("shared"), F.max("_a").alias("_n"), F.max("_b").alias("_m"))
    return facts.filter("_n > 0 AND _m > 0").select(work, "equal", "shared")


def recovery_plan(chapters: DataFrame, planned: DataFrame, work: str, ident: str, field: str) -> DataFrame:
    """(work, chapter, value, outcome) of a plan that fills gaps only: filled, same, kept (another value is there), or conflict (a value planned twice)."""
    twice = planned.groupBy(work, field).agg(F.count("*").alias("_n"))
    plan = planned.join(twice, [work, field]).select(work, ident, F.col(field).alias("_planned"), "_n")
    outcome = F.when(F.col("_n") > 1, "conflict").when(F.col(field).isNull(), "filled").when(F.col(field) == F.col("_planned"), "same").otherwise("kept")
    rows = chapters.join(plan, [work, ident])
    return rows.select(work, ident, F.when(outcome == "filled", F.col("_planned")).otherwise(F.col(field)).alias("value"), outcome.alias("outcome"))


def record_work(records: DataFrame, works: DataFrame, path: str, work: str) -> DataFrame:
    """Each record with the work whose id is the longest prefix of its path, at a slash; null if there is none."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    tried = records.select(path, F.explode(prefixes).alias("_prefix")).distinct()
    best = tried.join(works.select(F.col(work).alias("_prefix")).distinct(), "_prefix").groupBy(path).agg(F.max_by("_prefix", F.length("_prefix")).alias(work))
    return records.join(best, path, "left")


def board_works(posts: DataFrame, board: str, category: str, ident: str, lane: str, author: str, at: str, base: Column, order: Column) -> DataFrame:
    """Works of board posts: (board, category, base, work_id, author, chapters, last_at).

    A post that came as text and with its media counts once, as text; other lanes are left out,
    of several rows the latest stands. Posts group by board, category and base title as in
    ``preview``; a group in which a post lacks an author is no work. The author is the first
    chapter's, and the id a digest of board, category, base and author.
    """
    lanes = posts.filter(F.col(lane).isin("text", "both"))
    prefer = F.struct(F.col(lane) == "text", F.col(at))
    one = lanes.groupBy(board, category, ident).agg(F.max_by(F.struct(*(F.col(c) for c in posts.columns if c not in (board, category, ident))), prefer).alias("_row"))
    grouped, _ = preview(one.select(board, category, ident, "_row.*"), [board, category], base, order, ident)
    blank = F.coalesce(F.trim(author), F.lit("")) == ""
    works = grouped.groupBy(board, category, "base").agg(F.min_by(author, "position").alias("author"), F.count("*").alias("chapters"), F.max(at).alias("last_at"), F.count_if(blank).alias("_blank"))
    name = F.to_json(F.array(board, category, "base", F.lower("author")))
    return works.filter("_blank = 0").drop("_blank").withColumn("work_id", F.substring(F.sha2(name, 256), 1, 24))


def filled_from_headers(rows: DataFrame, headers: DataFrame, key: str, defaults: dict[str, str | None], blank: str = "-") -> DataFrame:
    """Rows of which empty fields (null, blanks or ``blank``) take the value of their text's header, or the default.

    ``headers`` has one row for each key, with a column for each field of ``defaults``.
    """
    found = headers.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in defaults))

    def known(column: Column) -> Column:
        return F.nullif(F.nullif(F.trim(column), F.lit("")), F.lit(blank))

    joined = rows.join(found, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({f: F.coalesce(known(F.col(f)), known(F.col(f"_{f}")), F.lit(default)) for f, default in defaults.items()}).select(*rows.columns)


def reviewed_links(candidates: DataFrame, decisions: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """The links that count: accepted candidates, and certain ones that nobody rejected; apply before groups are built.

    ``candidates`` has certain; ``decisions`` decision (accept or reject), of which the last in ``order``
    counts. The two ends may stand in either order, and an accepted pair that is no candidate counts, too.
    """
    ends = [F.least(left, right).alias(left), F.greatest(left, right).alias(right)]
    said = decisions.select(*ends, order, "decision").groupBy(left, right).agg(F.max_by("decision", order).alias("_said"))
    rows = candidates.select(*ends, "certain").groupBy(left, right).agg(F.max("certain").alias("_certain")).join(said, [left, right], "full")
    return rows.filter((F.col("_said") == "accept") | (F.col("_said").isNull() & F.col("_certain"))).select(left, right)


def split_links(labels: DataFrame, links: DataFrame, removed: DataFrame, left: str, right: str) -> DataFrame:
    """(id, canonical) after links were taken back by hand: only groups in which one stood are joined again.

    ``labels`` are those of all ``links``, ``removed`` the links taken back, in either
    direction. Members that no link holds any more are groups of their own; the labels of
    all other groups stay as they are. Removed links that never were change nothing.
    """
    both = removed.select(F.col(left).alias("_a"), F.col(right).alias("_b"))
    both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()
    was = links.join(both, (F.col(left) == F.col("_a")) & (F.col(right) == F.col("_b")), "left_semi")
    touched = was.join(labels, F.col(left) == F.col("id")).select("canonical").distinct()
    members = labels.join(touched, "canonical", "left_semi")
    inside = links.join(members.select(F.col("id").alias("_id")), F.col(left) == F.col("_id"), "left_semi").join(both, (F.col(left) == F.col("_a")) & (F.col(right) == F.col("_b")), "left_anti")
    again = merge_links(inside, left, right).select("id", F.col("canonical").alias("_new"))
    parted = members.select("id").join(again, "id", "left").select("id", F.coalesce("_new", "id").alias("canonical"))
    return labels.join(touched, "canonical", "left_anti").select("id", "canonical").unionByName(parted)
