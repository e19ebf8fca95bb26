"""A fiscal year from November to October, named for the year it ends in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The months of each quarter.
QUARTERS = {1: "November to January", 2: "February to April", 3: "May to July", 4: "August to October"}


def year(d: Column) -> Column:
    return F.year(F.add_months(d.cast("date"), 2))


def quarter(d: Column) -> Column:
    """1 to 4; October is in the fourth."""
    return F.quarter(F.add_months(d.cast("date"), 2))


def quarter_start(fiscal_year: Column, q: Column) -> Column:
    return F.when(q.between(1, 4), F.add_months(F.make_date(fiscal_year, 3 * q - 2, F.lit(1)), -2))


def quarter_end(fiscal_year: Column, q: Column) -> Column:
    return F.when(q.between(1, 4), F.last_day(F.add_months(F.make_date(fiscal_year, 3 * q, F.lit(1)), -2)))


def quarter_label(q: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in QUARTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, q), F.lit("Invalid quarter"))


def statement(d: Column) -> Column:
    y, q = year(d), quarter(d)
    return F.format_string(
        "%s is in fiscal year %d, quarter %d (%s to %s).", F.date_format(d, "yyyy-MM-dd"), y, q,
        F.date_format(quarter_start(y, q), "yyyy-MM-dd"), F.date_format(quarter_end(y, q), "yyyy-MM-dd"),
    )


def days_left(expires: Column, today: Column, warn: int = 30) -> tuple[Column, Column]:
    """Days until a date, and whether they are few enough to warn."""
    left = F.datediff(expires, today)
    return left, left <= warn
