"""Validity windows and calendar helpers; `today` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the days, and the days of a full offer week.
_DAYS = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")
_FULL_WEEK = 6


def day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def valid_on(valid_to: Column, today: str | Column) -> Column:
    """A window without an end never expires."""
    return valid_to.isNull() | (valid_to >= day(today))


def day_limited(start: Column, end: Column) -> Column:
    """Shorter than a full week; false for a missing or reversed window."""
    return F.coalesce((end >= start) & (F.datediff(end, start) + 1 < _FULL_WEEK), F.lit(False))


def valid_days(start: Column, end: Column) -> Column:
    """`Do–Sa`, or one day; null unless day_limited()."""
    names = F.array(*map(F.lit, _DAYS))
    name = lambda d: F.element_at(names, F.weekday(d) + 1)
    return F.when(day_limited(start, end), F.when(start == end, name(start)).otherwise(F.concat(name(start), F.lit("–"), name(end))))


def week_end(at: Column) -> Column:
    """The Sunday that ends the Monday-to-Sunday week of a date."""
    return F.date_add(F.date_trunc("week", at).cast("date"), 6)


def instant(text: Column) -> Column:
    """The moment that an ISO text with an offset names, `+0000`, `+02:00` or `Z`; one without an offset is UTC; null for other texts."""
    zoned = F.regexp_replace(text, r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    has = zoned.rlike(r"([+-]\d{2}:\d{2}|Z)$")
    return F.try_to_timestamp(F.when(has, zoned).otherwise(F.concat(zoned, F.lit("Z"))))


def local_day(at: Column, zone: str = "Europe/Berlin") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def offer_window(windows: Column, first: Column, last: Column) -> Column:
    """struct<valid_from, valid_to>: the hull of the profiles that meet the brochure's window, inside it; the window if none does.

    windows: array<struct<start timestamp, end timestamp>>, ends exclusive.
    """
    days = F.transform(windows, lambda w: F.struct(local_day(w["start"]).alias("a"), local_day(w["end"] - F.expr("interval 1 second")).alias("b")))
    real = F.filter(days, lambda d: d["a"].isNotNull() & d["b"].isNotNull() & (d["a"] <= last) & (d["b"] >= first))
    a = F.greatest(F.array_min(F.transform(real, lambda d: d["a"])), first)
    b = F.least(F.array_max(F.transform(real, lambda d: d["b"])), last)
    some = F.coalesce(F.size(real), F.lit(0)) > 0
    return F.struct(F.when(some, a).otherwise(first).alias("valid_from"), F.when(some, b).otherwise(last).alias("valid_to"))
