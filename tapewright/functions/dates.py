"""Dates and times as text: ``YYYY-MM-DD`` and ``HH:MM``, where hours from 24 to 29 belong to the day before and are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date forms at the end of file names, by precedence.
FILE_DATES = [
    r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})[-_]\(\d+\)(?=\.[^.]+$)",
    r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})\(\d+\)(?=\.[^.]+$)",
    r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})(?=\.[^.]+$)",
    r"(\d{4}) (\d{2}) (\d{2}) (\d{2}) (\d{2})(?=\.[^.]+$)",
    r"(\d{4}) (\d{2}) (\d{2}) (\d{2})[：:](\d{2})(?=\.[^.]+$)",
    r"(\d{4})_(\d{2})_(\d{2})_(\d{4})(?=\.[^.]+$)",
    r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?=\.[^.]+$)",
    r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(?=\.[^.]+$)",
    r"(\d{4})-(\d{2})-(\d{2})-(\d{4})(?=\.[^.]+$)",
]
#: Date and time anywhere in a file name, by precedence.
FILE_TIMES = [
    r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})-(\d{2})[：:](\d{2})",
    r"(\d{4}) (\d{2}) (\d{2}) (\d{2}) (\d{2})",
    r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})",
]
#: A recording's time at the end of a stem, and the range of a guide's first line.
RECORDED = r"(\d{4})[_\s](\d{2})[_\s](\d{2})[_\s](\d{2})[_\s](\d{2})(?:[_\s]\d{2})?(?:\.\w+)?$"
GUIDE_RANGE = r"(\d{4})/(\d{2})/(\d{2})\([^)]*\)\s*(\d{1,2}):(\d{2})[～~](\d{1,2}):(\d{2})"


def _date(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]))


def file_air_date(name: Column) -> Column:
    return F.coalesce(*[_date(name, p) for p in FILE_DATES])


def file_date_time(name: Column) -> Column:
    """struct(air_date, start_time) by the first form found, both null without."""
    time = lambda p: F.concat_ws(":", F.regexp_extract(name, p, 4), F.regexp_extract(name, p, 5))
    return F.struct(F.coalesce(*[_date(name, p) for p in FILE_TIMES]).alias("air_date"), F.coalesce(*[F.when(name.rlike(p), time(p)) for p in FILE_TIMES]).alias("start_time"))


def file_title(name: Column) -> Column:
    """What stands before the date and time in a file's stem."""
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    at = F.coalesce(*[F.nullif(F.regexp_instr(stem, F.lit(p)), F.lit(0)) for p in FILE_TIMES])
    cut = F.when(at.isNotNull(), F.regexp_replace(F.substr(stem, F.lit(1), at - 1), "[ _-]+$", "")).otherwise(stem)
    return F.regexp_replace(F.regexp_replace(cut, r"(?U)[\s　]+", " "), r"^ | $", "")


def recording_time(stem: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` that a stem ends with, null otherwise."""
    g = [F.regexp_extract(stem, RECORDED, i) for i in range(1, 6)]
    return F.when(stem.rlike(RECORDED), F.concat(F.concat_ws("-", *g[:3]), F.lit(" "), F.concat_ws(":", *g[3:])))


def guide_range(line: Column) -> Column:
    """struct(air_date, start_time, end_time) of ``YYYY/MM/DD(x) H:MM~H:MM``, null if the line has none."""
    g = [F.regexp_extract(line, GUIDE_RANGE, i) for i in range(1, 8)]
    time = lambda h, m: F.concat_ws(":", F.lpad(h, 2, "0"), m)
    return F.when(line.rlike(GUIDE_RANGE), F.struct(F.concat_ws("-", *g[:3]).alias("air_date"), time(g[3], g[4]).alias("start_time"), time(g[5], g[6]).alias("end_time")))


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False))


def year_month(c: Column) -> Column:
    """struct(year, month, error): error is missing_air_date, invalid_air_date or null."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    good = s.rlike(r"(?s)^\d{4}-\d{2}-.*$")
    return F.struct(F.when(good, F.substring(s, 1, 4)).alias("year"), F.when(good, F.substring(s, 6, 2)).alias("month"), F.when(s == "", "missing_air_date").when(~good, "invalid_air_date").alias("error"))


def date_of_mtime(c: Column) -> Column:
    day = F.substring(c, 1, 10)
    return F.when(is_iso_date(day), day)


def utc_text(ts: Column) -> Column:
    """ISO text with offset of a timestamp handed in; nothing here reads the clock."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def updated_at(c: Column) -> Column:
    """One timestamp for both text forms that writers use."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))
