"""Backward as-of join without a theta join.

Both sides are reduced to one row per (key, time), unioned, and the latest right payload is carried
forward by a running window: one shuffle, no row blow-up. Reducing first keeps a hot key small (a day
resolution key has at most one row per calendar day). Timestamps are always split into time buckets, an hour long unless
``bucket_seconds`` says otherwise; the last payload of earlier buckets is carried into each bucket as a seed row,
so the result stays exact while no task sees more than one bucket of one key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Bucket of a timestamp axis where the caller names none.
BUCKET_SECONDS = 3600


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None,
              by: Sequence[str] = (), tolerance_days: int | None = None, lag_days: int = 0,
              cols: Sequence[str] | None = None, tie_break: Sequence[str] = (),
              left_unique: bool = False, bucket_seconds: int | None = None,
              matched_on: str | None = None) -> DataFrame:
    """Attach to each left row the latest right row with ``right_on + lag_days <= on``.

    ``tolerance_days`` is inclusive: an older match becomes null. ``lag_days`` delays when a right row
    becomes visible. ``tie_break`` picks among right rows with equal key and time (largest wins).
    ``left_unique`` says left is already one row per (by, on), which saves the join back.
    ``matched_on`` names an output column for the time of the matched right row.
    """
    by = list(by)
    right_on = right_on or on
    if bucket_seconds is None and "timestamp" in left.schema[on].dataType.typeName():
        bucket_seconds = BUCKET_SECONDS  # a day bounds a key's rows by the calendar, a timestamp by nothing
    cols = [c for c in (cols or right.columns) if c not in by and c != right_on]
    right = right.where(F.col(right_on).isNotNull())
    visible = F.date_add(F.col(right_on), lag_days) if lag_days else F.col(right_on)
    facts = right.select(*by, visible.alias("_t"),
                         F.struct(*[F.col(c).alias(f"_b_{c}") for c in tie_break],
                                  F.col(right_on).alias("_at"),
                                  *[F.col(c) for c in cols]).alias("_p"))
    facts = facts.groupBy(*by, "_t").agg(F.max("_p").alias("_p"))
    payload_type = facts.schema["_p"].dataType

    keep = [c for c in left.columns if c not in by and c != on] if left_unique else []
    spine = left.where(F.col(on).isNotNull()).select(
        *by, F.col(on).alias("_t"), *([F.struct(*keep).alias("_l")] if keep else []))
    if not left_unique:
        spine = spine.distinct()

    rows = facts.withColumn("_side", F.lit(0)).unionByName(
        spine.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(payload_type)),
        allowMissingColumns=True)
    part = list(by)
    if bucket_seconds:
        rows = rows.withColumn("_b", F.floor(F.unix_timestamp(F.col("_t").cast("timestamp")) / bucket_seconds))
        ends = rows.groupBy(*by, "_b").agg(
            F.max(F.when(F.col("_side") == 0, F.struct("_t", "_p"))).alias("_last"))
        over_buckets = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b")
        seeds = ends.select(*by, "_b", F.last("_last", ignorenulls=True).over(
            over_buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"))
        seeds = seeds.where("_last is not null").select(
            *by, "_b", F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"),
            F.col("_last._p").alias("_p"), F.lit(-1).alias("_side"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
        part.append("_b")
    w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(
        F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance_days is not None:
        fresh = F.date_diff(F.col("_t").cast("date"), F.col("_m._at").cast("date")) <= tolerance_days
        found = found.withColumn("_m", F.when(fresh, F.col("_m")))
    outs = [F.col(f"_m.{c}").alias(c) for c in cols]
    if matched_on:
        outs.append(F.col("_m._at").alias(matched_on))
    if left_unique:
        kept = [F.col(f"_l.{c}").alias(c) for c in keep]
        return found.select(*by, F.col("_t").alias(on), *kept, *outs)
    found = found.select(*by, F.col("_t").alias(on), *outs)
    return left.join(found, [*by, on], "left")


def asof_change(spine: DataFrame, series: DataFrame, on: str, series_on: str, value: str, *,
                level: str, change: str | None, tolerance_days: int | None = None,
                years_back_days: int = 365) -> DataFrame:
    """Unkeyed as-of level of a series on the spine's distinct days, plus its year-over-year change.

    One as-of pass serves both dates: day d and day d-365 are two rows of the same probe table.
    """
    from tidespine.functions.scalar import yoy

    days = spine.select(on).distinct()
    probe = days.select(F.col(on).alias("_q")).unionByName(
        days.select(F.date_sub(on, years_back_days).alias("_q"))) if change else days.select(F.col(on).alias("_q"))
    src = series.select(F.col(series_on).alias("_s"), F.col(value).cast("double").alias("_v"))
    hit = asof_join(probe.distinct(), src, on="_q", right_on="_s", tolerance_days=tolerance_days, left_unique=True)
    now = days.join(hit.withColumnRenamed("_q", on).withColumnRenamed("_v", level), on, "left")
    if not change:
        return now
    back = hit.select(F.date_add("_q", years_back_days).alias(on), F.col("_v").alias("_prior"))
    return now.join(back, on, "left").withColumn(change, yoy(level, "_prior")).drop("_prior")
