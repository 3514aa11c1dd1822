"""Listings of other sites as JSON: catalogue pages, works with their episodes, threads and responses.

Only named fields are read, so whatever else a record holds (keys, addresses) goes no further.
Numbers given as JSON texts count as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names under which sites give their rows, and what an access word means.
ROW_FIELDS = ("works", "content", "items", "results")
FREE_WORDS = ("free", "public")
PAID_WORDS = ("point", "paid", "locked", "restricted")


def _once(value: Column, made) -> Column:
    """What ``made`` gives for a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), made)[0]


def _get(text: Column, *path: str) -> Column:
    return F.get_json_object(text, "$." + ".".join(path))


def _object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.nullif(F.regexp_extract(text, r"(?s)^\{.*", 0), F.lit(""))


def _array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)^\[.*", 0), F.lit(""))


def _digits(text: Column, most: int = 18) -> Column:
    return F.when(F.regexp_like(text, F.lit(rf"^\d{{1,{most}}}$")), text.try_cast("long"))


def _cut(text: Column, most: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def catalogue_page(page: Column, default_size: int = 20) -> Column:
    """struct(fault, works, total, size) of a page; with a fault all else is null.

    Rows stand in ``data`` or under one of the names in ``data`` or beside it. Faults are
    shape_unknown, paging_invalid, rows_rejected (a row without a number as id), duplicate_id.
    """
    data = _get(page, "data")
    rows = F.coalesce(_array(data), *(_array(_get(page, "data", f)) for f in ROW_FIELDS), *(_array(_get(page, f)) for f in ROW_FIELDS))
    found = F.from_json(rows, "array<struct<id: string, slug: string, title: string, authorName: string, author: string>>")
    total = F.coalesce(_get(page, "data", "total"), _get(page, "data", "totalElements"), _get(page, "total"), F.lit("0"))
    size = F.coalesce(_get(page, "data", "size"), _get(page, "data", "pageSize"), _get(page, "size"), F.lit(str(default_size)))

    def judged(read: Column) -> Column:
        idents = F.transform(read["found"], lambda r: r["id"])
        return (
            F.when(read["found"].isNull(), "shape_unknown").when(_digits(read["total"]).isNull() | ~F.coalesce(_digits(read["size"]) > 0, F.lit(False)), "paging_invalid")
            .when(F.exists(idents, lambda i: _digits(i).isNull()), "rows_rejected").when(F.size(F.array_distinct(idents)) < F.size(idents), "duplicate_id")
        )

    def told(read: Column, fault: Column) -> Column:
        works = F.transform(read["found"], lambda r: F.struct(r["id"].alias("id"), _cut(r["slug"], 300).alias("slug"), _cut(r["title"], 500).alias("title"), _cut(F.coalesce(F.nullif(r["authorName"], F.lit("")), r["author"]), 300).alias("author")))
        fine = fault.isNull()
        return F.struct(fault.alias("fault"), F.when(fine, works).alias("works"), F.when(fine, _digits(read["total"])).alias("total"), F.when(fine, _digits(read["size"])).alias("size"))

    return _once(F.struct(found.alias("found"), total.alias("total"), size.alias("size")), lambda read: _once(judged(read), lambda fault: told(read, fault)))


def access(price: Column, is_free: Column, word: Column) -> Column:
    """free, point, or unknown where nothing or both are said."""
    amount, said = _digits(price), F.lower(word)
    free = F.coalesce(is_free == "true", F.lit(False)) | F.coalesce(amount == 0, F.lit(False)) | F.coalesce(said.isin(*FREE_WORDS), F.lit(False))
    paid = F.coalesce(is_free == "false", F.lit(False)) | F.coalesce(amount > 0, F.lit(False)) | F.coalesce(said.isin(*PAID_WORDS), F.lit(False))
    return F.when(free == paid, "unknown").when(free, "free").otherwise("point")


def _episode(row: Column, place: Column) -> Column:
    raw = F.coalesce(row["episodeNumber"], row["number"])
    number = F.when(F.regexp_like(raw, F.lit(r"^\d{1,12}(?:\.\d{1,6})?$")), raw.try_cast("decimal(18,6)"))
    title = F.nullif(F.trim(row["title"]), F.lit(""))
    label = _cut(F.coalesce(title, F.regexp_replace(number.cast("string"), r"\.?0+$", "")), 300)
    kind = F.nullif(F.trim(F.coalesce(F.nullif(row["chapterKind"], F.lit("")), row["kind"])), F.lit(""))
    word = F.coalesce(F.nullif(row["access"], F.lit("")), row["status"])
    return F.struct(
        row["id"].alias("id"), label.alias("label"), title.isNotNull().alias("has_title"), kind.alias("kind"), number.alias("number"), raw.alias("number_raw"), place.alias("toc_position"),
        F.nullif(row["publishedAt"], F.lit("")).alias("published_at"), access(F.coalesce(row["price"], row["points"]), row["isFree"], word).alias("access"),
    )


def work_detail(detail: Column) -> Column:
    """struct(fault, work_id, title, author, episodes) of a work's page; with a fault all else is null.

    Episodes without a number as id are left out, but keep their place. Faults are
    shape_unknown, id_invalid, episodes_unknown and episodes_incomplete (fewer than announced).
    """
    fields = ("id", "price", "points", "isFree", "access", "status", "episodeNumber", "number", "title", "chapterKind", "kind", "publishedAt")

    def read(data: Column, work: Column) -> Column:
        rows = F.coalesce(*(_array(_get(holder, name)) for holder in (data, work) for name in ("episodes", "chapters")))
        found = F.from_json(rows, f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>")
        episodes = F.filter(F.transform(found, _episode), lambda e: _digits(e["id"]).isNotNull())
        author = _cut(F.coalesce(F.nullif(_get(work, "authorName"), F.lit("")), _get(work, "author")), 300)
        return F.struct(
            work.isNotNull().alias("known"), _get(work, "id").alias("work_id"), _cut(_get(work, "title"), 500).alias("title"), author.alias("author"), episodes.alias("episodes"), _get(work, "episodeCount").alias("announced")
        )

    def judged(r: Column) -> Column:
        return (
            F.when(~r["known"], "shape_unknown").when(_digits(r["work_id"]).isNull(), "id_invalid").when(r["episodes"].isNull(), "episodes_unknown")
            .when(_digits(r["announced"]) > F.size(r["episodes"]), "episodes_incomplete")
        )

    def told(r: Column, fault: Column) -> Column:
        return F.struct(fault.alias("fault"), *(F.when(fault.isNull(), r[f]).alias(f) for f in ("work_id", "title", "author", "episodes")))

    return _once(
        F.coalesce(_object(_get(detail, "data")), _object(F.trim(detail))),
        lambda data: _once(F.coalesce(_object(_get(data, "work")), data), lambda work: _once(read(data, work), lambda r: _once(judged(r), lambda fault: told(r, fault)))),
    )


def _time(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:?\d\d)$")), text.try_cast("timestamp"))


def _between(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def thread_record(raw: Column) -> Column:
    """struct(status, thread_id, title, username, created_at, updated_at, response_count, ended, top) of a listed thread.

    The status is fine, dropped (deleted or not published) or invalid; all else is null unless fine.
    """
    names = ("id", "title", "username", "createdAt", "updatedAt", "responseCount", "ended", "top", "deleted", "published")
    return _once(F.struct(_object(F.trim(raw)).isNotNull().alias("object"), *(_get(raw, f).alias(f) for f in names)), _thread)


def _thread(fields: Column) -> Column:
    ident, count = _digits(fields["id"]), _digits(fields["responseCount"])
    good = (
        F.coalesce(ident.between(1, 10**9), F.lit(False)) & F.coalesce(count <= 100_000, F.lit(False)) & F.coalesce(fields["ended"].isin("true", "false"), F.lit(False))
        & _between(fields["title"], 1, 500) & _between(fields["username"], 1, 200) & _time(fields["createdAt"]).isNotNull() & _time(fields["updatedAt"]).isNotNull()
    )
    dropped = F.coalesce((fields["deleted"] == "true"), F.lit(False)) | F.coalesce(fields["published"] == "false", F.lit(False))
    status = F.when(~fields["object"], "invalid").when(dropped, "dropped").when(good, "fine").otherwise("invalid")
    kept = {
        "thread_id": ident, "title": fields["title"], "username": fields["username"], "created_at": _time(fields["createdAt"]), "updated_at": _time(fields["updatedAt"]),
        "response_count": count, "ended": fields["ended"] == "true", "top": F.coalesce(fields["top"] == "true", F.lit(False)),
    }
    return F.struct(status.alias("status"), *(F.when(status == "fine", c).alias(n) for n, c in kept.items()))


def response_record(raw: Column, thread_id: Column) -> Column:
    """struct(status, seq, username, author_id, content, attachment, created_at) of a response of a thread: fine or invalid."""
    names = ("threadId", "seq", "username", "authorId", "content", "attachment", "createdAt")
    return _once(F.struct(_object(F.trim(raw)).isNotNull().alias("object"), *(_get(raw, f).alias(f) for f in names)), lambda fields: _response(fields, thread_id))


def _response(fields: Column, thread_id: Column) -> Column:
    seq = _digits(fields["seq"])
    good = (
        fields["object"] & (F.coalesce(fields["threadId"], thread_id.cast("string")) == thread_id.cast("string")) & F.coalesce(seq <= 100_000, F.lit(False))
        & _between(fields["username"], 0, 200) & _between(fields["content"], 0, 200_000) & _time(fields["createdAt"]).isNotNull()
        & _between(F.coalesce(fields["authorId"], F.lit("")), 0, 64) & _between(F.coalesce(fields["attachment"], F.lit("")), 0, 2000)
    )
    status = F.when(F.coalesce(good, F.lit(False)), "fine").otherwise("invalid")
    kept = {
        "seq": seq, "username": fields["username"], "author_id": F.coalesce(fields["authorId"], F.lit("")), "content": fields["content"],
        "attachment": F.nullif(fields["attachment"], F.lit("")), "created_at": _time(fields["createdAt"]),
    }
    return F.struct(status.alias("status"), *(F.when(status == "fine", c).alias(n) for n, c in kept.items()))
