"""Periods. A date never gets an invented time; an always-open period has no dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
#: Fixed value: "always open".
ALWAYS = "상시"
_DAY = r"(\d{4}-\d{2}-\d{2})"
_MINUTE = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})"


def _range(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """First range in the text: whether there is one, start, end."""
    pattern = rf"(?U){pattern}\s*~\s*{pattern}"
    some = text.isNotNull() & ~text.contains(ALWAYS) & text.rlike(pattern)
    return some, F.when(some, F.regexp_extract(text, pattern, 1)), F.when(some, F.regexp_extract(text, pattern, 2))


def date_range(text: Column) -> Column:
    """Struct (start, end, error): dates of "YYYY-MM-DD ~ YYYY-MM-DD"; an impossible date is an error, order isn't checked."""
    some, start, end = _range(text, _DAY)
    start, end = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    bad = some & (start.isNull() | end.isNull())
    return F.struct(F.when(~bad, start).alias("start"), F.when(~bad, end).alias("end"), F.when(bad, "invalid date").alias("error"))


def instant(text: Column, zone: str = ZONE) -> Column:
    """A local "yyyy-MM-dd HH:mm" as an instant; null if there is no such time. The session's zone must be UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(text, r"(?U)\s+", " "), F.lit("yyyy-MM-dd HH:mm")), zone)


def datetime_range(text: Column, zone: str = ZONE) -> Column:
    """Struct (start, end, error): instants of "YYYY-MM-DD HH:MM ~ YYYY-MM-DD HH:MM"; an end before the start is an error."""
    some, start, end = _range(text, _MINUTE)
    start, end = instant(start, zone), instant(end, zone)
    error = F.when(some & (start.isNull() | end.isNull()), "invalid datetime").when(end < start, "end precedes start")
    return F.struct(F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), end).alias("end"), error.alias("error"))


def date_unless_known(at: Column, day: Column) -> Column:
    """The date of a boundary whose instant isn't known."""
    return F.when(at.isNull(), day)
