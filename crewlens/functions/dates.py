"""Months, spans, durations, fiscal years and billing cycles as column expressions; the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PIVOT = 49  # two-digit years up to it are of this century
FIRST_YEAR = 1950


def full_year(digits: Column) -> Column:
    n = digits.try_cast("int")
    return F.when(F.length(digits) >= 4, n).when(n <= PIVOT, n + 2000).otherwise(n + 1900)


def _first_of(year: Column, month: Column, last_year: int) -> Column:
    def dated(s: Column) -> Column:
        good = s["y"].between(FIRST_YEAR, last_year) & s["m"].between(1, 12)
        return F.when(good, F.make_date(F.when(good, s["y"]), F.when(good, s["m"]), F.lit(1)))

    return let(F.struct(year.alias("y"), month.alias("m")), dated)


def month_date(c: Column, last_year: int) -> Column:
    """The first of the month of ``Mon YYYY``, ``Mon YY``, ``m/yyyy`` or ``m.yy``, or of January for ``YYYY``; else null.

    The three forms begin with a letter, are four digits, or neither, so each text is searched for one of them.
    """
    named, number = r"^([a-z]{3,9})\.?[\s'’/-]*(\d{4}|\d{2})$", r"^(\d{1,2})[/.-](\d{4}|\d{2})$"

    def read(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k)
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.left(part(named, 1), F.lit(3))).cast("int")
        by_name = _first_of(let(part(named, 2), full_year), month, last_year)
        by_number = _first_of(let(part(number, 2), full_year), F.try_to_number(F.nullif(part(number, 1), F.lit("")), F.lit("99")).cast("int"), last_year)
        by_year = _first_of(t.try_cast("int"), F.lit(1), last_year)
        return F.when(t.rlike("^[a-z]"), by_name).when(t.rlike(r"^\d{4}$"), by_year).otherwise(by_number)

    return let(F.lower(F.trim(c)), read)


def fiscal_span(c: Column) -> Column:
    """(start, end) of ``YYYY-YY`` or ``FY2021-22``: the first January to the last December; null otherwise."""
    t = F.upper(F.trim(c))
    pattern = r"^(?:FY\s*)?(\d{4})\s*[-/]\s*(\d{2}|\d{4})$"
    a, b = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    first = F.when(a != "", a.cast("int"))
    last = F.when(F.length(b) == 4, b.cast("int")).when(F.length(b) == 2, F.floor(first / 100).cast("int") * 100 + b.cast("int"))
    return F.when(first.isNotNull() & (last >= first), F.struct(F.make_date(first, F.lit(1), F.lit(1)).alias("start"), F.make_date(last, F.lit(12), F.lit(31)).alias("end")))


def months_inclusive(start: Column, end: Column) -> Column:
    """Calendar months between two dates, one more if the end's day reaches the start's, at least one."""
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + F.when(F.day(end) >= F.day(start), 1).otherwise(0)
    return F.greatest(n, F.lit(1))


def valid_span(start: Column, end: Column, today: Column) -> Column:
    """Whether a span is in order, has begun and does not end after the current month."""
    return F.coalesce((start <= end) & (start <= today) & (F.trunc(end, "month") <= F.trunc(today, "month")), F.lit(False))


def duration_text(months: Column) -> Column:
    """``2 years 3 months``, without parts that are zero."""
    unit = lambda n, w: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n > 1, "s").otherwise("")))
    return F.concat_ws(" ", unit(F.floor(months / 12), "year"), unit(months % 12, "month"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days of 86,400 seconds."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)


def cycle_start(anchor: Column, now: Column, days: int) -> Column:
    """The last anchor + k * days that is not after ``now``; the anchor itself before it."""
    k = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(anchor)) / (days * 86400)), F.lit(0))
    return F.timestamp_add("DAY", (k * days).cast("int"), anchor)


def experience_level(years: Column) -> Column:
    return F.when(years <= 2, "Junior").when(years <= 5, "Mid-level").when(years <= 10, "Senior").when(years > 10, "Lead/Expert").otherwise("")


def preset(name: str, today: str) -> tuple[str, str]:
    """The inclusive dates of today, yesterday, last_7 or last_30."""
    import datetime as dt

    day = dt.date.fromisoformat(today)
    back = {"today": (0, 0), "yesterday": (1, 1), "last_7": (6, 0), "last_30": (29, 0)}
    if name not in back:
        raise ValueError(f"no such preset: {name}")
    a, b = (day - dt.timedelta(days=n) for n in back[name])
    return a.isoformat(), b.isoformat()
