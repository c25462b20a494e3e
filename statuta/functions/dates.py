"""Dates in free text and canonical forms.

The phrases and the shapes of dates in the patterns below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def explicit_day(text: Column) -> Column:
    """The first day written dd/mm/yyyy, dd-mm-yyyy or yyyy-mm-dd that exists."""
    dmy = F.regexp_extract(text, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 0)
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    part = F.split(F.regexp_replace(dmy, "-", "/"), "/")
    day = F.concat_ws("-", F.get(part, F.lit(2)), F.lpad(F.get(part, F.lit(1)), 2, "0"), F.lpad(F.get(part, F.lit(0)), 2, "0"))
    return F.coalesce(F.when(dmy != "", F.try_to_date(day, "yyyy-MM-dd")), F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")))


def temporal_scope(text: Column) -> Column:
    """Day, current validity, month, year or none, the first that the text has: ``granularity, start, end``."""
    day = explicit_day(text)
    current = text.rlike(r"(?iu)\b(hiện hành|currently|in force)\b")
    month = F.regexp_extract(text, r"(?iu)(?:tháng|month)\s+(\d{1,2})[/\s]+(?:năm\s+)?(\d{4})", 1), F.regexp_extract(text, r"(?iu)(?:tháng|month)\s+(\d{1,2})[/\s]+(?:năm\s+)?(\d{4})", 2)
    month_start = F.try_to_date(F.concat_ws("-", month[1], F.lpad(month[0], 2, "0"), F.lit("01")), "yyyy-MM-dd")
    year = F.regexp_extract(text, r"(?iu)(?:năm|year|in)\s+(\d{4})", 1)
    year_start = F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")
    none = F.lit(None).cast("date")

    def scope(name: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(name).alias("granularity"), start.alias("start"), end.alias("end"))

    return (
        F.when(day.isNotNull(), scope("day", day, day))
        .when(current, scope("current", none, none))
        .when((month[0] != "") & month_start.isNotNull(), scope("month", month_start, F.last_day(month_start)))
        .when((year != "") & year_start.isNotNull(), scope("year", year_start, F.date_sub(F.add_months(year_start, 12), 1)))
        .otherwise(scope("none", none, none))
    )


def canonical_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def effective_date(effective: Column, issued: Column) -> Column:
    """The effective date, else the issue date, else the epoch; texts that are no dates count as missing."""
    return F.coalesce(F.try_to_date(effective, "yyyy-MM-dd"), F.try_to_date(issued, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))


def spoken_scope(text: Column) -> Column:
    """``granularity, start, end`` of a Vietnamese question: an existing day in figures or words, else current validity, else a
    month, a year, a span of versions (``versions``), or none; lengths of time are none."""
    none = F.lit(None).cast("date")

    def scope(name: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(name).alias("granularity"), start.alias("start"), end.alias("end"))

    def day_of(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def groups(pattern: str, n: int) -> list[Column]:
        return [F.regexp_extract(text, pattern, i) for i in range(n)]

    said = groups(r"(?iu)(?:ngày\s*)?(\d{1,2})[/-](\d{1,2})[/-](\d{4})|ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})", 7)
    iso = groups(r"\b(\d{4})-(\d{2})-(\d{2})\b", 4)
    day = F.when(said[3] != "", day_of(*said[3:0:-1])).when(said[6] != "", day_of(*said[6:3:-1])).when(iso[0] != "", day_of(*iso[1:]))
    month = groups(r"(?iu)tháng\s*(\d{1,2})\s*(?:năm|/)\s*(\d{4})", 3)
    month_start = F.when(month[0] != "", day_of(month[2], month[1], F.lit("1")))
    year = groups(r"(?iu)(?:năm|trong năm)\s*(\d{4})", 2)
    year_start = F.when(year[0] != "", day_of(year[1], F.lit("1"), F.lit("1")))
    return (
        F.when(day.isNotNull(), scope("day", day, day))
        .when(text.rlike("(?iu)hiện hành|hiện nay|đang có hiệu lực|còn hiệu lực"), scope("current", none, none))
        .when(month_start.isNotNull(), scope("month", month_start, F.last_day(month_start)))
        .when(year_start.isNotNull(), scope("year", year_start, F.date_sub(F.add_months(year_start, 12), 1)))
        .when(text.rlike("(?iu)(?:trước và sau|trước|sau) khi\\s+(?:sửa đổi|bãi bỏ|thay thế)"), scope("versions", none, none))
        .otherwise(scope("none", none, none))
    )


def source_effective(text: Column) -> Column:
    """``day, status`` of the commencement that a source states: ``one`` day, ``none``, ``conflict`` or ``invalid``."""
    pattern = F.lit(r"(?iu)có\s+hiệu\s+lực(?:\s+thi\s+hành)?\s+(?:kể\s+)?từ\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})")
    d, m, y = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3))
    days = F.array_distinct(F.transform(F.arrays_zip(d.alias("d"), m.alias("m"), y.alias("y")), lambda x: F.try_to_date(F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0")), "yyyy-MM-dd")))
    status = F.when(F.exists(days, lambda x: x.isNull()), "invalid").when(F.size(days) > 1, "conflict").when(F.size(days) == 1, "one").otherwise("none")
    return F.struct(F.when(status == "one", F.get(days, F.lit(0))).alias("day"), status.alias("status"))


ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def iso_day(text: Column) -> Column:
    """A day written yyyy-mm-dd that exists, as text; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def iso_time(text: Column) -> Column:
    """An ISO day or time, as it is written; null for anything else."""
    return F.when(text.rlike(ISO_TIME) & F.try_to_timestamp(text).isNotNull(), text)


def zone_of(text: Column) -> Column:
    """``zoned``, ``naive``, or ``none`` for what is no ISO time."""
    return F.when(iso_time(text).isNull(), "none").when(F.regexp_extract(text, ISO_TIME, 1) != "", "zoned").otherwise("naive")


def contains_year(day: Column, part: str) -> Column:
    return F.contains(day.cast("string"), F.lit(part))
