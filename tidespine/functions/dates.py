"""Calendar expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidespine.functions.scalar import col


def quarter_end(d: str | Column) -> Column:
    """Last day of the quarter that holds ``d``."""
    d = col(d)
    return F.last_day(F.make_date(F.year(d), (F.quarter(d) * 3).cast("int"), F.lit(1)))


def quarter_label(d: str | Column) -> Column:
    """'2024Q1' style label."""
    d = col(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def prior_quarter_end(d: str | Column) -> Column:
    return quarter_end(F.add_months(col(d), -3))


def half_year_start(d: str | Column) -> Column:
    d = col(d)
    return F.make_date(F.year(d), F.when(F.month(d) <= 6, 1).otherwise(7), F.lit(1))


def is_weekend(d: str | Column) -> Column:
    return F.dayofweek(col(d)).isin(1, 7)


def parse_day(s: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; unparsable text becomes null instead of failing the job."""
    return F.try_to_timestamp(col(s), F.lit(fmt)).cast("date")


def month_period(year: Column, period: Column) -> Column:
    """First day of the month named by year and 'M01'..'M12'."""
    return F.make_date(year.cast("int"), F.substring(period, 2, 2).cast("int"), F.lit(1))


def spreadsheet_day(s: str | Column) -> Column:
    """Spreadsheet serial number (days since 1899-12-30), ISO text or US text to a date."""
    s = col(s)
    serial = s.try_cast("double")
    return F.coalesce(
        F.when(serial.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))),
        parse_day(F.substring(s, 1, 10)),
        parse_day(s, "M/d/yyyy"),
    )
