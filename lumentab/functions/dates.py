"""Completed months and years, and dates moved by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def completed_months(start: Column, end: Column) -> Column:
    """Whole months from start to end: the last one counts when its day is reached."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def completed_years(start: Column, end: Column) -> Column:
    return F.floor(completed_months(start, end) / 12)


def derive(kind: str, source: Column, as_of: Column) -> Column:
    """years_since, months_since, days_since and days_until of a source date."""
    kinds = {
        "years_since": lambda: completed_years(source, as_of), "months_since": lambda: completed_months(source, as_of),
        "days_since": lambda: F.datediff(as_of, source), "days_until": lambda: F.datediff(source, as_of),
    }
    return kinds[kind]()


def add_years(d: Column, n: int | Column) -> Column:
    """29 February becomes the 28th where there is none."""
    return F.add_months(d, n * 12)


# Directives of date formats and what they are here.
DIRECTIVES = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


def date_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i : i + 2] in DIRECTIVES:
            out += DIRECTIVES[fmt[i : i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def parsed_date(c: Column, fmt: str | None = None) -> Column:
    """ISO or by format; null where it isn't one."""
    return F.try_to_date(c, date_pattern(fmt) if fmt else "yyyy-MM-dd")
