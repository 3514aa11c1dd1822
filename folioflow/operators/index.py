"""The search index: validated rows in catalogue order, normalised once, and searches over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx

#: Fixed order of the fields of an index row; the last ones may be missing in older indexes.
FIELDS = ("board_id", "external_post_id", "title", "author", "category", "created_at_raw", "payload_sha256")
SORTS = ("latest", "oldest", "views", "comments")


def catalogue_order(created_at: str, first_seen_at: str, ident: str, board: str) -> list[Column]:
    """Newest first: by the source's date, or when a post was first seen; then by id and board."""
    return [F.coalesce(created_at, first_seen_at).desc_nulls_last(), F.col(ident).desc(), F.col(board).desc()]


def row_fault(rows: DataFrame) -> Column:
    """Why a row can't stand in an index, or null: board, id, payload, mode or count."""
    fault = F.when(F.col("board_id").isNull(), "board").when(F.col("external_post_id").isNull(), "id")
    fault = fault.when(~F.coalesce(F.regexp_like("payload_sha256", F.lit("^[0-9a-f]{64}$")), F.lit(False)), "payload")
    if "is_aa" in rows.columns:
        fault = fault.when(F.col("is_aa").isNull(), "mode")
    for name in ("views", "comment_count"):
        if name in rows.columns:
            fault = fault.when(~F.coalesce(F.col(name) >= 0, F.lit(False)), "count")
    return fault


def build(rows: DataFrame) -> DataFrame:
    """An index of rows that have no fault, with what searches look at: terms, title_terms, author_terms and category_key.

    is_aa, views and comment_count are null where ``rows`` lacks them. ``rows`` needs the
    ``FIELDS`` and newest, a column by which later posts are larger and of which no two are
    equal. Write the index once and search the table.
    """
    missing = [name for name in (*FIELDS, "newest") if name not in rows.columns]
    if missing:
        raise ValueError(f"unsupported index: no {', '.join(missing)}")
    kinds = {"is_aa": "boolean", "views": "long", "comment_count": "long"}
    good = rows.filter(row_fault(rows).isNull())
    extra = [F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    return good.select(
        *FIELDS, "newest", *extra,
        tx.searchable(F.col("board_id"), F.col("title"), F.col("author"), F.col("category")).alias("terms"), tx.searchable(F.col("title")).alias("title_terms"),
        tx.searchable(F.col("author")).alias("author_terms"), F.lower(tx.nfkc(F.coalesce("category", F.lit("")))).alias("category_key"),
    )


def matches(index: DataFrame, query: str = "", *, board: str = "", category: str = "", mode: str = "all", target: str = "all", match: str = "and") -> DataFrame:
    """Rows that hold all (``match`` and) or any (or) words of the query in their target, of one board, category and mode."""
    if mode not in ("all", "aa", "prose") or target not in ("all", "title", "author") or match not in ("and", "or"):
        raise ValueError("unsupported search")
    found = index
    if board:
        found = found.filter(F.col("board_id") == board)
    if category:
        found = found.filter(F.col("category_key") == " ".join([tx.unicodedata.normalize("NFKC", category).lower()]))
    if mode != "all":
        found = found.filter(F.col("is_aa") == F.lit(mode == "aa"))
    column = {"all": "terms", "title": "title_terms", "author": "author_terms"}[target]
    return found.filter(tx.contains_words(F.col(column), query, match == "and"))


def search(index: DataFrame, query: str = "", *, sort: str = "latest", limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """A page of the matches in one of four orders; ties of views and comments go to the newer post.

    Only the rows up to the end of the page are kept by any task.
    """
    if sort not in SORTS or not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("unsupported search")
    newest = F.col("newest").desc()
    order = {"latest": [newest], "oldest": [F.col("newest").asc()], "views": [F.desc("views"), newest], "comments": [F.desc("comment_count"), newest]}[sort]
    return matches(index, query, **filters).orderBy(*order).offset(offset).limit(limit)


def board_metadata(rows: DataFrame, boards: DataFrame, board: str) -> DataFrame:
    """Rows with name, group and count of their board; nulls for unknown boards."""
    return rows.join(boards, board, "left")


def excerpts(records: DataFrame, query: str, fields: list[str], at: str) -> DataFrame:
    """Excerpts in which every word of the query stands in some field, newest first (column place)."""
    found = records.filter(tx.contains_words(tx.searchable(*(F.col(f) for f in fields)), query))
    return found.orderBy(F.col(at).desc_nulls_last())


def shelf_counts(works: DataFrame, shelves: DataFrame, shelf: str) -> DataFrame:
    """Works per shelf, 0 for empty ones; works on no shelf or an unknown one are unsorted."""
    known = shelves.select(F.col(shelf).alias("_known")).distinct()
    placed = works.join(known, F.col(shelf) == F.col("_known"), "left").groupBy(F.coalesce("_known", F.lit("unsorted")).alias(shelf)).agg(F.count("*").alias("n"))
    every = known.select(F.col("_known").alias(shelf)).unionByName(works.sparkSession.createDataFrame([("unsorted",)], f"{shelf} string"))
    return every.join(placed, shelf, "left").select(shelf, F.coalesce("n", F.lit(0)).alias("n"))


def natural(title: Column, width: int = 12) -> Column:
    """A sort key in which numbers stand in the order of their values: digits are padded to ``width``."""
    parts = F.regexp_extract_all(F.lower(title), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), width, "0")).otherwise(p)), "")


def work_list(works: DataFrame, query: str, fields: list[str], order: str, keep: Column | None = None) -> DataFrame:
    """Works that hold every word of the query in one of the fields, in one of the orders title, largest, longest, newest or oldest."""
    rows = works.filter(tx.contains_words(tx.searchable(*(F.col(f) for f in fields)), query))
    rows = rows if keep is None else rows.filter(keep)
    orders = {"title": [natural(F.col("title")), F.col("id")], "largest": [F.desc("bytes"), F.col("id")], "longest": [F.desc("chapters"), F.col("id")], "newest": [F.col("updated").desc_nulls_last(), F.col("id")], "oldest": [F.col("updated").asc_nulls_last(), F.col("id")]}
    return rows.orderBy(*orders[order])


def compare_window(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows with their place from 1."""
    return rows.orderBy(*order).limit(size).withColumn("place", F.row_number().over(Window.orderBy(*order)))
