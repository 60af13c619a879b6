"""Texts and keys for display, staleness, and lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.validity import week_end


def euro(cents: Column) -> Column:
    """1234 as `12,34 €`; null stays null."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))


def percent(value: Column) -> Column:
    """`-33%`, rounded half up; empty for null."""
    return F.coalesce(F.concat(F.lit("-"), F.floor(value + 0.5).cast("string"), F.lit("%")), F.lit(""))


def clean_unit(unit: Column) -> Column:
    """The unit without remarks in parentheses and without its leading `je`; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(unit, r"\s*\([^)]*\)", ""), r"(?i)^je\s+", "")), F.lit(""))


def per_unit_shown(text: Column) -> Column:
    """`1 kg = 3.5` as `3,5 €/kg`, of `2.19 €/Stk.` what is before and behind the slash; of several values the first; null for other texts."""
    sides = F.split(text, "=")
    unit, value = F.regexp_replace(F.trim(sides[0]), r"^1\s+", ""), F.trim(F.split(F.trim(F.get(sides, F.lit(1))), "/")[0])
    part = lambda n: F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)\s*€?\s*/\s*(\S+)", n)
    shown = lambda v, u: F.when((v != "") & (u != ""), F.concat(F.regexp_replace(v, r"^([^.]*)\.", "$1,"), F.lit(" €/"), u))
    return F.when(F.contains(text, F.lit("=")), shown(value, unit)).otherwise(shown(part(1), F.regexp_replace(part(2), "[.,]$", "")))


def brand_title(brand: Column) -> Column:
    """Brands without a small letter get them, but for the first letter of every word; others stay. An empty one is null."""
    words = F.regexp_extract_all(F.lower(brand), F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return F.nullif(F.when(brand == F.upper(brand), title).otherwise(brand), F.lit(""))


def as_of(at: Column, now: Column) -> Column:
    """How old something is: `just now`, `5m ago`, `9:14` on the same day, `Mon 9:00` within a week, `18 Jun` before; empty for null. Both are timestamps of the reader's clock."""
    seconds = F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6
    clock = F.concat(F.hour(at).cast("string"), F.lit(":"), F.lpad(F.minute(at).cast("string"), 2, "0"))
    return (
        F.when(at.isNull(), "").when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(F.to_date(at) == F.to_date(now), clock)
        .when(seconds < 7 * 86400, F.concat(F.date_format(at, "EEE "), clock)).otherwise(F.date_format(at, "d MMM"))
    )


def deals_stale(fetched: Column, now: Column) -> Column:
    """Deals fetched in an earlier week than now are stale."""
    return now > week_end(fetched)


def cache_stale(fetched: Column, version: Column, now: Column, current: int) -> Column:
    """Whether kept deals must be fetched again: there are none, they were kept by another version, or their week is over."""
    return F.coalesce(deals_stale(fetched, now) | (version != current), F.lit(True))


def delta_message(before: Column, after: Column) -> Column:
    """`3 new`, `2 removed`, or null."""
    return F.when(after > before, F.concat((after - before).cast("string"), F.lit(" new"))).when(after < before, F.concat((before - after).cast("string"), F.lit(" removed")))


def first_containing(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose text stands in the column."""
    out = F.lit(default)
    for token, label in reversed(rules):
        out = F.when(F.contains(text, F.lit(token)), label).otherwise(out)
    return out


def label_of(key: Column, labels: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))
