"""Attaching feature tables to a spine.

Families keyed by (ticker, date) are joined on exactly these two keys one after another: the spine is
shuffled and sorted once and keeps that layout through the whole chain. Market-wide families hold one
row per calendar day, a bounded size, and are broadcast.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KEYS = ["ticker", "date"]


def spine_of(panel: DataFrame) -> DataFrame:
    """Distinct (ticker, date)."""
    return panel.select(*KEYS).distinct()


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


def attach(spine: DataFrame, family: DataFrame, cols: Sequence[str], zero: bool = False) -> DataFrame:
    out = spine.join(family.select(*KEYS, *cols), KEYS, "left")
    return fill_zero(out, cols) if zero else out


def attach_daily(spine: DataFrame, daily: DataFrame, cols: Sequence[str], zero: bool = False) -> DataFrame:
    out = spine.join(F.broadcast(daily.select("date", *cols)), "date", "left")
    return fill_zero(out, cols) if zero else out
