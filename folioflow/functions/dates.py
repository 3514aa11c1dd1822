"""Source dates as UTC times: absolute forms, and forms relative to the time of capture in Korean time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
ABSOLUTE = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM.dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yy.MM.dd HH:mm", "yy.MM.dd", "yy/MM/dd HH:mm", "yy-MM-dd HH:mm",
)
SECONDS = {"초": 1, "분": 60, "시간": 3600, "일": 86400, "주": 604800}


def source_time(raw: Column, captured_at: Column, zone: str = ZONE) -> Column:
    """The UTC time of a source date; null where it has no known form.

    Forms without a year or day are read at the time of capture, in ``zone``: a date of
    which the year would make it later than the capture is of the year before (29 February:
    of the last year that has one), a time later than the capture is of the day before.
    """
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    local = F.from_utc_timestamp(captured_at, zone)

    def utc(at: Column) -> Column:
        return F.to_utc_timestamp(at, zone)

    def parsed(value: Column, form: str) -> Column:
        return F.try_to_timestamp(value, F.lit(form))

    zoned = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$")), text.try_cast("timestamp"))
    plain = F.replace(text, F.lit("T"), F.lit(" "))
    absolute = F.coalesce(*(utc(parsed(plain, form)) for form in ABSOLUTE))

    count = F.regexp_extract(text, r"^(\d+) ?(초|분|시간|일|주) ?전$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^(\d+) ?(초|분|시간|일|주) ?전$", 2)
    seconds = F.lit(None).cast("long")
    for word, size in SECONDS.items():
        seconds = F.when(unit == word, count * size).otherwise(seconds)
    ago = F.when(text == "방금", captured_at).when(text == "어제", F.timestamp_add("DAY", F.lit(-1), captured_at)).when(seconds.isNotNull(), F.timestamp_add("SECOND", -seconds, captured_at))

    clock = F.regexp_extract(text, r"^(\d{1,2}:\d\d)$", 1)
    today = parsed(F.concat(F.date_format(local, "yyyy-MM-dd "), F.lpad(clock, 5, "0")), "yyyy-MM-dd HH:mm")
    timed = F.when(clock != "", utc(F.when(today > local, F.timestamp_add("DAY", F.lit(-1), today)).otherwise(today)))

    day = F.regexp_replace(F.regexp_extract(text, r"^(\d\d[-./]\d\d)( \d\d:\d\d)?$", 1), "[./]", "-")
    hour = F.nullif(F.trim(F.regexp_extract(text, r"^(\d\d[-./]\d\d)( \d\d:\d\d)?$", 2)), F.lit(""))
    years = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda back: F.try_to_timestamp(F.concat((F.year(local) - back).cast("string"), F.lit("-"), day, F.lit(" "), F.coalesce(hour, F.lit("00:00"))), F.lit("yyyy-MM-dd HH:mm")))
    dated = F.when(day != "", utc(F.element_at(F.concat(F.filter(years, lambda at: at.isNotNull() & (at <= local)), F.array(F.lit(None).cast("timestamp"))), 1)))
    return F.coalesce(zoned, ago, timed, dated, absolute)


def repaired(rows: DataFrame, value: str, raw: str, captured_at: str) -> DataFrame:
    """Rows of which missing times are read from their source date as of the last capture; known times stay."""
    return rows.withColumn(value, F.coalesce(F.col(value), source_time(F.col(raw), F.col(captured_at)).cast(rows.schema[value].dataType)))
