"""Catalogue search: matches, pages with neighbours, facets, discovery, suggestions and keyword in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_around(matches: DataFrame, value: str, key: str, size: int, around) -> DataFrame:
    """The page on which the row with key ``around`` stands, by value (descending, nulls last) and key, with its neighbours' keys.

    Positions count from 0 over all matches. The rows before the anchor are only counted;
    sorting is by two top-k selections of at most a page each. No row with that key: no rows.
    """
    anchor = matches.filter(F.col(key) == F.lit(around)).select(value).first()
    if anchor is None:
        return matches.filter(F.lit(False)).withColumns({"position": F.lit(0).cast("long"), "previous_id": F.col(key), "next_id": F.col(key), "page": F.lit(0).cast("long")})
    same, at = F.col(value).eqNullSafe(F.lit(anchor[0])), F.lit(anchor[0])
    ahead = F.col(value).isNotNull() if anchor[0] is None else F.col(value) > at
    earlier = F.coalesce(ahead, F.lit(False)) | (same & (F.col(key) < F.lit(around)))
    position = matches.filter(earlier).count()
    inside = position % size
    # one row more on either side, for the neighbours of the first and the last row
    head = matches.filter(earlier).orderBy(F.col(value).asc_nulls_first(), F.desc(key)).limit(inside + 1)
    tail = matches.filter(~earlier).orderBy(F.col(value).desc_nulls_last(), F.asc(key)).limit(size - inside + 1)
    row = Window.orderBy(F.col(value).desc_nulls_last(), F.asc(key))
    first = position - min(inside + 1, position)
    rows = head.unionByName(tail).withColumns({"position": (F.row_number().over(row) - 1 + first).cast("long"), "previous_id": F.lag(key).over(row), "next_id": F.lead(key).over(row)})
    return rows.withColumn("page", F.floor(F.col("position") / size)).filter(F.col("page") == position // size)


def facets(rows: DataFrame, keys: list[str], label: Column, normal: Column) -> DataFrame:
    """Labels by frequency, spellings of one normal form merged under the most used one."""
    spelled = rows.groupBy(*keys, normal.alias("facet"), label.alias("spelling")).agg(F.count("*").alias("n"))
    return spelled.groupBy(*keys, "facet").agg(F.sum("n").alias("n"), F.max_by("spelling", F.struct("n", "spelling")).alias("label"))


def keyword_in_context(docs: DataFrame, word: str, before: int = 36, after: int = 36) -> DataFrame:
    """(id, hit, start, before, exact, after) of each place where the word stands in a text, in any case, without overlaps.

    Places are of the text itself, whatever its lower case looks like. One text's hits are in one task.
    """
    pattern = r"(?iu)\Q" + word.replace("\\E", r"\E\\E\Q") + r"\E"
    rows = docs.filter(F.regexp_like("text", F.lit(pattern))).select("id", "text", F.posexplode(F.transform(F.split("text", pattern), F.length)).alias("hit", "size"))
    upto = Window.partitionBy("id").orderBy("hit").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(upto) + F.col("hit") * len(word)).withColumn("pieces", F.max("hit").over(Window.partitionBy("id")))
    begin = F.greatest(F.lit(0), F.col("start") - before)
    return rows.filter("hit < pieces").select(
        "id", "hit", "start",
        F.substring("text", begin + 1, F.col("start") - begin).alias("before"),
        F.substring("text", F.col("start") + 1, F.lit(len(word))).alias("exact"),
        F.substring("text", F.col("start") + 1 + len(word), F.lit(after)).alias("after"),
    )


def on_this_day(posts: DataFrame, at: str, today: Column) -> DataFrame:
    """Posts of earlier years with the month and day of ``today``."""
    same = (F.month(at) == F.month(today)) & (F.day(F.col(at)) == F.day(today))
    return posts.filter(same & (F.year(at) < F.year(today)))


def hot(posts: DataFrame, at: str, key: str, comments: str, views: str, newest: int = 2000, size: int = 20) -> DataFrame:
    """The most commented of the ``newest`` posts; ties go to more views, then to the newer post."""
    recent = posts.orderBy(F.desc(at), F.desc(key)).limit(newest)
    return recent.filter(F.col(comments) > 0).orderBy(F.desc(comments), F.desc(views), F.desc(at), F.desc(key)).limit(size)


def resolve(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of up to 500 wanted keys in their order (column place), nulls for those not found."""
    if len(wanted) > 500:
        raise ValueError("at most 500 keys at a time")
    asked = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"place int, {key} {rows.schema[key].dataType.simpleString()}")
    found = rows.filter(F.col(key).isin(list(set(wanted))))  # reaches the scan
    return asked.join(found, key, "left")


def board_kind(posts: DataFrame, board: str, drawn: Column) -> DataFrame:
    """all where every post of the board is drawn, none where no post is, else null."""
    counts = posts.groupBy(board).agg(F.bool_and(drawn).alias("_all"), F.bool_or(drawn).alias("_any"))
    return counts.select(board, F.when(F.col("_all"), "all").when(~F.col("_any"), "none").alias("kind"))


def smart_views(works: DataFrame, views: dict[str, Column]) -> DataFrame:
    """How many works each saved view holds, in one pass over the works."""
    counts = works.agg(*(F.count_if(predicate).alias(name) for name, predicate in views.items()))
    return counts.unpivot([], list(views), "view", "n")


def term_index(docs: DataFrame, key: str, text: Column, trigrams: bool = False) -> DataFrame:
    """(term, documents, places, bytes) of the words or letter trigrams of all texts.

    A document's terms are sorted and counted in place, so only its distinct ones leave it.
    Rows of one key are documents of their own.
    """
    if trigrams:
        whole = F.coalesce(text, F.lit(""))
        letters = F.filter(F.split(whole, ""), lambda c: c != "")  # split once: a place in a text of many bytes is found by counting
        terms = F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - 2, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, F.lit(3)), ""))
    else:
        terms = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\f\r]+")
    begins = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (t[i - 1] != t[i - 2]))
    counted = lambda t, b: F.zip_with(b, F.concat(F.slice(b, 2, 1 << 30), F.array(F.size(t) + 1)), lambda i, j: F.struct(t[i - 1].alias("term"), (j - i).alias("_n")))
    once = lambda value, use: F.transform(F.array(value), use)[0]
    runs = once(F.array_sort(terms), lambda t: once(begins(t), lambda b: counted(t, b)))
    per = docs.select(F.explode(runs).alias("_run")).select("_run.*").filter("term <> ''")
    return per.groupBy("term").agg(F.count("*").alias("documents"), F.sum("_n").alias("places"), F.octet_length(F.first("term")).cast("long").alias("bytes"))


def annotation_at(lookups: DataFrame, marks: DataFrame, document: str, offset: str, start: str, stop: str, at: str, ident: str) -> DataFrame:
    """Each lookup with the id of the mark over its offset, the latest where several are; null where there is none.

    Marks and lookups meet by document and block of a thousand places, so only marks near an offset are compared with it.
    """
    block = 1000
    spread = marks.filter(F.col(start) < F.col(stop)).select(
        F.col(document).alias("_document"), F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(stop) - 1) / block))).alias("_block"),
        F.col(start).alias("_start"), F.col(stop).alias("_stop"), F.struct(F.col(at), F.col(ident)).alias("_mark"),
    )
    over = (F.col(document) == F.col("_document")) & (F.floor(F.col(offset) / block) == F.col("_block")) & (F.col(offset) >= F.col("_start")) & (F.col(offset) < F.col("_stop"))
    asked = lookups.select(document, offset).distinct()
    best = asked.join(spread, over).groupBy(document, offset).agg(F.max("_mark")[ident].alias("annotation"))
    return lookups.join(best, [document, offset], "left")


def excerpt_markdown(quote: Column, note: Column, work: Column, title: Column, at: Column) -> Column:
    """An excerpt in Markdown: its lines as a quote, its note, and where and on which day it was taken."""
    place = F.concat_ws(" › ", F.nullif(work, F.lit("")), F.nullif(title, F.lit("")))
    remark = F.when(F.coalesce(note, F.lit("")) != "", F.concat(note, F.lit("\n\n"))).otherwise("")
    where = F.concat(F.lit("— "), F.coalesce(F.nullif(place, F.lit("")), F.lit("제목 없음")), F.lit(" · "), F.date_format(at, "yyyy-MM-dd"))
    return F.concat(F.regexp_replace(quote, r"(?m)^", "> "), F.lit("\n\n"), remark, where, F.lit("\n\n---\n"))
