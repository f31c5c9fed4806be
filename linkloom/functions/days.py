"""Day numbers, seasons and half-open windows. Day 0 is 1946-01-01; everything is exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1946-01-01"
SEASON_FLIP_MONTH = 7


def day_number(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit(EPOCH).cast("date"))


def date_of(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), day)


def season_of(date: Column) -> Column:
    """A season is named by the year it ends in; it begins on the first of July."""
    return F.year(date) + F.when(F.month(date) >= SEASON_FLIP_MONTH, 1).otherwise(0)


def season_from_code(code: Column) -> Column:
    """Digits two to five of a season code are the year it begins in."""
    return F.substring(code, 2, 4).cast("int") + 1


def month_window(year: Column, month: Column) -> tuple[Column, Column]:
    first = F.make_date(year, month, F.lit(1))
    return day_number(first), day_number(F.add_months(first, 1))


def year_window(year: Column) -> tuple[Column, Column]:
    return day_number(F.make_date(year, F.lit(1), F.lit(1))), day_number(F.make_date(year + 1, F.lit(1), F.lit(1)))


def dated_bound(kind: Column, year: Column, month: Column, day: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The half-open window of a date known to the day, month or year, or of a season bracket; other kinds are an error."""
    on = day_number(F.make_date(year, month, day))
    m, y = month_window(year, month), year_window(year)
    bad = F.raise_error(F.concat(F.lit("unknown bound kind: "), F.coalesce(kind, F.lit("null")))).cast("int")
    pick = lambda d, i: F.when(kind == "day", d).when(kind == "month", m[i]).when(kind == "year", y[i])
    return pick(on, 0).when(kind == "bracket", low).otherwise(bad), pick(on + 1, 1).when(kind == "bracket", high).otherwise(bad)


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def window_intersection(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> tuple[Column, Column]:
    """The common part of two windows; both null where there is none."""
    low, high = F.greatest(a_low, b_low), F.least(a_high, b_high)
    return F.when(low < high, low), F.when(low < high, high)


def interval_text(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), date_of(start).cast("string"), F.lit(", "), date_of(end).cast("string"), F.lit(")"))


# The eras, their leagues and their seasons.
ERAS = (
    ("BAA 1946-49", "BAA", None, None),
    ("1950-66", "NBA", 1950, 1966),
    ("1967-80", "NBA", 1967, 1980),
    ("1981-99", "NBA", 1981, 1999),
    ("2000-2025/26", "NBA", 2000, 2026),
)


def era_label(league: Column, season: Column) -> Column:
    """The era of a league's season; null outside all eras."""
    out = F.lit(None).cast("string")
    for name, own, first, last in ERAS:
        out = F.when((league == own) & (F.lit(True) if first is None else season.between(first, last)), name).otherwise(out)
    return out


def date_precision(text: Column) -> tuple[Column, Column]:
    """How exactly a written date is known (precise, fuzzy, unknown), and its ISO form as far as it is: a day, a month or a year.

    The whole text, its white space collapsed, must be a date: ``January 5, 2001``, ``January ?, 2001``, ``2001`` or ``? 2001``.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    month = "January|February|March|April|May|June|July|August|September|October|November|December"
    number = lambda name: F.lpad(F.array_position(F.array(*[F.lit(m) for m in month.split("|")]), name).cast("string"), 2, "0")
    day, fuzzy, year = rf"^({month}) (\d{{1,2}}), ?(\d{{4}})$", rf"^({month}) \?+, ?(\d{{4}})$", r"^\?? ?(\d{4})$"
    part = lambda form, i: F.regexp_extract(t, form, i)
    iso = (
        F.when(t.rlike(day), F.concat_ws("-", part(day, 3), number(part(day, 1)), F.lpad(part(day, 2), 2, "0")))
        .when(t.rlike(fuzzy), F.concat_ws("-", part(fuzzy, 2), number(part(fuzzy, 1))))
        .when(t.rlike(year), part(year, 1))
    )
    return F.when(t.rlike(day), "precise").when(iso.isNotNull(), "fuzzy").otherwise("unknown"), iso
