"""Dates as statements print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date formats, in the order in which they are tried.
FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy")

#: The first letters of the months.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_date(text: Column) -> Column:
    """The date by the first format that reads it, else null."""
    text = F.trim(text.cast("string"))
    return F.coalesce(*(F.try_to_date(text, f) for f in FORMATS))


def recover_date(description: Column, start: Column, end: Column) -> Column:
    """The date of a description that begins with month and day, if it falls in the statement's period. The year is the
    period's first, else its last."""
    month, day = (F.regexp_extract(description, r"^\s*(\d{1,2})[/-](\d{1,2})(?:\s|$)", i) for i in (1, 2))

    def dated(year: Column) -> Column:
        found = F.try_to_date(F.concat_ws("-", year.cast("string"), month, day), "yyyy-M-d")
        last = F.coalesce(end, F.try_to_date(F.concat((F.year(start) + 1).cast("string"), F.lit("-12-31")), "yyyy-M-d"))
        return F.when(found.between(start, last), found)

    return F.when(month != "", F.coalesce(dated(F.year(start)), dated(F.year(F.coalesce(end, start)))))


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters, else 0."""
    return F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.lower(F.left(name, F.lit(3))))


def assembled(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd as text; null where a part is missing or there is no such month or day; short years are of this century."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    full = F.when(y > 99, y).otherwise(2000 + y)
    return F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), F.format_string("%04d-%02d-%02d", full, m, d))


def iso_text(text: Column) -> Column:
    """yyyy-MM-dd as text from ISO, month-first, unambiguous day-first and month-name spellings, else null. Years of two
    digits are of this century; days are checked against 31 alone."""
    text = F.trim(text)
    iso, slashed = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$"
    day_name, name_day = r"^(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{2,4})$", r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{2,4})$"
    a, b, year = (F.regexp_extract(text, slashed, i) for i in (1, 2, 3))
    day_first = (a.try_cast("int") > 12) & (b.try_cast("int") <= 12)
    first, second, last = ([F.regexp_extract(text, p, i) for i in (1, 2, 3)] for p in (iso, day_name, name_day))
    return (
        F.when(text.rlike(iso), assembled(*first))
        .when(text.rlike(slashed), F.when(day_first, assembled(year, b, a)).otherwise(assembled(year, a, b)))
        .when(text.rlike(day_name), assembled(second[2], month_number(second[1]), second[0])).when(text.rlike(name_day), assembled(last[2], month_number(last[0]), last[1]))
    )


def row_date(tokens: Column, year: Column) -> Column:
    """date (yyyy-MM-dd as text) and used (tokens that it took) at the head of a printed row's words: ISO, month first
    with slashes, or a month's name before or after the day; a date without a year takes `year`, and is null (its tokens
    taken nonetheless) where that is null."""
    bare = lambda i: F.regexp_replace(F.get(tokens, F.lit(i)), r"^[ ,]+|[ ,]+$", "")
    dotless = lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")
    first, second = bare(0), bare(1)
    iso, slashed, whole = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$", r"^\d{4}$"
    parts = lambda p: [F.regexp_extract(first, p, i) for i in (1, 2, 3)]
    month, day, year = parts(slashed)[0], parts(slashed)[1], year.cast("string")
    named, after = month_number(dotless(first)), month_number(dotless(F.get(tokens, F.lit(1))))
    found = lambda date, used: F.struct(date.alias("date"), F.lit(used).alias("used"))

    def dated(third: Column, m: Column, d: Column) -> Column:
        return F.when(third.rlike(whole), found(assembled(third, m, d), 3)).otherwise(found(assembled(year, m, d), 2))

    return (
        F.when(first.rlike(iso), found(assembled(*parts(iso)), 1)).when(first.rlike(slashed), found(assembled(parts(slashed)[2], month, day), 1))
        .when((named > 0) & second.rlike(r"^\d"), dated(bare(2), named, F.regexp_extract(second, r"^(\d{1,2})", 1)))
        .when(first.rlike(r"^\d{1,2}$") & (after > 0), dated(F.get(tokens, F.lit(2)), after, first)).otherwise(found(F.lit(None).cast("string"), 0))
    )
