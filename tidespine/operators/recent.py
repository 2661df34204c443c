"""Reading backwards from one day: the newest rows of each key without its whole history, and independent jobs side by side."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidespine.session import cut_lineage

#: Each further range is so many times as long as all before it.
WIDER = 4


def between_days(df: DataFrame, on: str, day: dt.date, days: int, later: bool = False) -> DataFrame:
    """Rows from ``days`` before ``day`` up to it (``later``: and all after it), as plain comparisons that reach the scan and prune partitions."""
    kept = F.col(on) >= F.lit(day - dt.timedelta(days))
    return df.where(kept if later else kept & (F.col(on) < F.lit(day + dt.timedelta(1))))


def recent(df: DataFrame, day: dt.date, on: str, keys: DataFrame, enough: Column, days: int) -> DataFrame:
    """Rows of ``df`` on or before ``day``, as far back as every key of ``keys`` needs, and maybe further.

    The last ``days`` are read for all keys. ``enough`` is an aggregate condition over a key's rows so far; keys that fail it are read on, in ranges
    ``WIDER`` times as long, until none fails or nothing older is there. So a table partitioned by day is read to the depth the keys need,
    not to its beginning; a key younger than that depth costs one look at the older days, for that key alone. Keys in no row are left as they are.
    """
    by = keys.columns
    keys = keys.distinct()
    parts, short, floor, lo, hi = [], keys, None, day - dt.timedelta(days), day
    while True:
        rows = df.where((F.col(on) >= F.lit(lo)) & (F.col(on) < F.lit(hi + dt.timedelta(1))))
        parts.append(cut_lineage(rows if short is keys else rows.join(short, by, "left_semi")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        full = found.groupBy(*by).agg(enough.alias("_enough")).where("_enough").select(*by)
        short = cut_lineage(keys.join(full, by, "left_anti"))
        if short.isEmpty():
            return found
        if floor is None:
            floor = df.agg(F.min(on).cast("date")).first()[0]
        if floor is None or lo <= floor:
            return found
        hi = lo - dt.timedelta(1)
        lo = max(floor, day - dt.timedelta(((day - lo).days + 1) * (WIDER + 1)))


def kth_day(df: DataFrame, day: dt.date, on: str, k: int, days: int) -> dt.date:
    """The k-th newest distinct day on or before ``day``, the oldest where there are fewer, ``day`` where there is none."""
    every = F.lit(1).alias("_all")
    got = recent(df.select(every, on).distinct(), day, on, df.sparkSession.range(1).select(every), F.count_distinct(on) >= k, days)
    newest = got.select(on).distinct().orderBy(F.col(on).desc()).limit(k).collect()
    return newest[-1][0] if newest else day


def together(jobs: dict[str, Callable[[], Any]], threads: int = 8) -> dict[str, Any]:
    """Results of independent jobs, run side by side, so small ones fill the executors. The first failure is raised after all have ended."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(max(1, min(threads, len(jobs)))) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
    return {name: w.result() for name, w in waiting.items()}


__all__: Sequence[str] = ["between_days", "kth_day", "recent", "together"]
