"""Dates and payment terms kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings by pattern, in the order they are tried; a dash is any of these signs. A month's name holds a
#: letter, so that a year's zeros (2000) are none.
DASH = "[-/.–—"
DAY_NAME = rf"^(\d{{1,2}}){DASH} ]*([A-Za-z][A-Za-z0]{{2,}}|0[A-Za-z][A-Za-z0]+){DASH} ]+(\d{{2,4}})"
NUMBERS = rf"^(\d{{1,2}}){DASH}](\d{{1,2}}){DASH}](\d{{2,4}})"
NAME_DAY = rf"^([A-Za-z]{{3,}}){DASH} ]+(\d{{1,2}}),?{DASH} ]+(\d{{2,4}})"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month(word: Column) -> Column:
    """The month's number that a word's first three letters name, 0 if none; a 0 among them stands for an o."""
    return F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.replace(F.lower(F.left(word, F.lit(3))), F.lit("0"), F.lit("o"))).cast("int")


def normalize(value: Column) -> Column:
    """`dd-MM-yyyy` of a date's beginning: day and month's name, numbers by day, month and year, month's name and day,
    or year first. Blank where none fits, a day is over 31 or a month is none; the calendar isn't asked further."""
    text = F.trim(value)
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    shown = lambda d, m, y: F.concat_ws("-", two(d), two(m), year(y))
    found = [[F.regexp_extract(text, p, k) for k in (1, 2, 3)] for p in (DAY_NAME, NUMBERS, NAME_DAY, YEAR_FIRST)]
    (d1, n1, y1), (d2, m2, y2), (n3, d3, y3), (y4, m4, d4) = found
    day = lambda d: d.try_cast("int").between(1, 31)
    return (
        F.when(d1 != "", F.when(day(d1) & (_month(n1) > 0), shown(d1, _month(n1), y1)).otherwise(""))
        .when(d2 != "", F.when(day(d2) & m2.try_cast("int").between(1, 12), shown(d2, m2, y2)).otherwise(""))
        .when((n3 != "") & (_month(n3) > 0), shown(d3, _month(n3), y3))
        .when(y4 != "", shown(d4, m4, y4))
        .otherwise("")
    )


def term_days(terms: Column) -> Column:
    """Days of a payment term; 30 where it says none."""
    days = F.regexp_extract(F.lower(terms), r"(\d+)\s*days?", 1).try_cast("int")
    return F.when(F.contains(F.lower(terms), F.lit("100% advance")), 0).otherwise(F.coalesce(days, F.lit(30)))


def add_days(date: Column, days: Column) -> Column:
    """A text date moved by days."""
    return F.date_format(F.date_add(F.to_date(date, "dd-MM-yyyy"), days), "dd-MM-yyyy")
