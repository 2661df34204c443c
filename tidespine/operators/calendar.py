"""Positions on a shared calendar: lags that count calendar rows, not the entity's own rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def calendar_index(df: DataFrame, on: str = "date", out: str = "idx") -> DataFrame:
    """(on, idx): dense position of each distinct day. Bounded by the number of calendar days."""
    days = df.select(on).distinct().agg(F.array_sort(F.collect_list(on)).alias("_all"))
    return days.select(F.posexplode("_all").alias(out, on)).select(on, out)


def with_calendar(df: DataFrame, calendar: DataFrame | None = None, on: str = "date", out: str = "idx") -> DataFrame:
    calendar = calendar if calendar is not None else calendar_index(df, on, out)
    return df.join(calendar, on, "inner")


def calendar_lag(df: DataFrame, value: str, n: int, out: str, by: str = "ticker", idx: str = "idx") -> DataFrame:
    """``value`` exactly ``n`` calendar rows earlier, null where the entity has no row there.

    A one-value range frame on the calendar position replaces the self-join.
    """
    w = Window.partitionBy(by).orderBy(idx).rangeBetween(-n, -n)
    return df.withColumn(out, F.first(value).over(w))


def calendar_change(df: DataFrame, value: str, n: int, out: str, by: str = "ticker", idx: str = "idx") -> DataFrame:
    lagged = calendar_lag(df, value, n, "_lagged", by, idx)
    return lagged.withColumn(out, F.try_divide(F.col(value), F.col("_lagged")) - 1).drop("_lagged")


def fill_gaps(df: DataFrame, calendar: DataFrame, value: str, by: str = "ticker", on: str = "date",
              idx: str = "idx") -> DataFrame:
    """Expand each entity to every calendar day after its first row, carrying the value forward.

    Each row is stretched to the day before the entity's next row (``sequence`` over positions), so no
    calendar x entity product is formed.
    """
    rows = df.join(calendar, on, "inner").where(F.col(value).isNotNull())
    last = calendar.agg(F.max(idx)).scalar()  # one number, as a scalar subquery
    nxt = F.lead(idx).over(Window.partitionBy(by).orderBy(idx))
    rows = rows.withColumn("_next", nxt).withColumn("_last", last)
    stretched = rows.select(
        by, value, F.explode(F.sequence(F.col(idx), F.coalesce(F.col("_next") - 1, F.col("_last")))).alias(idx))
    return stretched.join(calendar, idx, "inner").select(by, on, idx, value)
