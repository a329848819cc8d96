"""Date columns. Every two-digit-year rule takes its pivot as a constant, so results do not change with the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their three-letter forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

US = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s*$"


def full_year(y: Column, pivot: int | None) -> Column:
    """Two-digit years up to ``pivot`` are 20yy, later ones 19yy; without a pivot all are 20yy."""
    n = y.try_cast("int")
    return F.when(F.length(y) == 4, n).when(n <= (99 if pivot is None else pivot), 2000 + n).otherwise(1900 + n)


def make_day(y: Column, m: Column, d: Column) -> Column:
    """A date, null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def parse_us(c: Column, pivot: int | None) -> Column:
    """M/D/YY or M/D/YYYY."""
    part = lambda k: F.regexp_extract(c, US, k)
    n = lambda k: part(k).try_cast("int")
    return F.when(c.rlike(US), make_day(full_year(part(3), pivot), n(1), n(2)))


def range_start(c: Column) -> Column:
    """What stands before the dash of a span of slashed dates."""
    return F.when((F.length(c) > 10) & F.contains(c, F.lit("-")) & F.contains(c, F.lit("/")), F.trim(F.regexp_extract(c, r"^([^-]*)", 1))).otherwise(c)


def month_number(name: Column) -> Column:
    n = F.lower(F.left(F.trim(name), F.lit(3)))
    full = F.lower(F.trim(name))
    out = F.lit(None).cast("int")
    for k, m in enumerate(MONTHS, 1):
        out = F.when((full == m) | ((n == m[:3]) & (F.length(full) == 3)), k).otherwise(out)
    return out


def parse_linkage(c: Column, pivot: int) -> Column:
    """ISO prefix, M/D/Y, ``Month D, YYYY``, ``Month YYYY`` (its 15th)."""
    t = F.trim(c)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    g = lambda p, k: F.regexp_extract(t, p, k)
    long, short = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$"
    worded = F.when(t.rlike(long), make_day(g(long, 3).try_cast("int"), month_number(g(long, 1)), g(long, 2).try_cast("int")))
    month = F.when(t.rlike(short), make_day(g(short, 2).try_cast("int"), month_number(g(short, 1)), F.lit(15)))
    return F.coalesce(iso, parse_us(t, pivot), worded, month)


def parse_record(c: Column, pivot: int) -> Column:
    """struct<date, precision>: M/D/Y, or the first day of a span of them."""
    d = parse_us(range_start(F.trim(c)), pivot)
    return F.struct(d.alias("date"), F.when(d.isNotNull(), "day").otherwise("unknown").alias("precision"))


def parse_release(c: Column) -> Column:
    """``%m/%d/%y`` with years 69-99 in the 1900s, ISO, ``%m/%d/%Y``, in this order."""
    return F.coalesce(parse_us(F.trim(c), 68), F.try_to_date(F.trim(c), "yyyy-MM-dd"))


def parse_report(c: Column) -> Column:
    """struct<at, precision>: ``M/D/Y H:M`` to the minute, ``M/D/Y`` to the day, else unknown."""
    minute = F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy H:mm"))
    day = F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy"))
    return F.struct(F.coalesce(minute, day).alias("at"), F.when(minute.isNotNull(), "minute").when(day.isNotNull(), "day").otherwise("unknown").alias("precision"))


def parse_case(c: Column) -> Column:
    """struct<date, precision>: trailing year, a month name, the first short number as the day; firsts stand in."""
    y = F.regexp_extract(c, r"(\d{4})\s*$", 1).try_cast("int")
    m = month_number(F.regexp_extract(F.lower(c), r"\b(" + "|".join(f"{x}|{x[:3]}" for x in MONTHS) + r")\b", 1))
    d = F.regexp_extract(F.regexp_replace(c, r"\d{4}\s*$", ""), r"(?<!\d)(\d{1,2})(?!\d)", 1).try_cast("int")
    full = make_day(y, m, d)
    date = F.coalesce(full, make_day(y, m, F.lit(1)), make_day(y, F.lit(1), F.lit(1)))
    return F.struct(date.alias("date"), F.when(full.isNotNull(), "day").when(m.isNotNull() & y.isNotNull(), "month").when(y.isNotNull(), "year").otherwise("unknown").alias("precision"))


def parse_rfc2822(c: Column) -> Column:
    """Mail-style time, e.g. of a feed item; null if unreadable."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s(GMT|UTC|Z)$", " +0000")
    return F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))


def from_epoch(c: Column) -> Column:
    """Epoch seconds to ISO in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso_prefix(c: Column) -> Column:
    return F.try_to_date(F.left(F.trim(c), F.lit(10)), "yyyy-MM-dd")


def parse_exif(c: Column) -> Column:
    """``Y:M:D H:M:S``, taken as UTC."""
    return F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss"))
