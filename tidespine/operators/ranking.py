"""Ranks, top shares and exact quantiles that never gather a whole group in one task.

A window ordered inside a group puts the group in one task, which fails when one group holds a third
of the data. Here rows are first reduced to one row per (group, value) with a map-side partial
aggregate, then range-partitioned by (group, value). Each range task sums only its own rows; the
offset of a range inside its group comes from a small table with one row per (range, group).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.session import cut_lineage


def weight_before(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str) -> DataFrame:
    """Add ``ahead`` (group weight strictly before the row) and ``total`` (group weight).

    ``order`` together with ``by`` must identify a row, so the range partitioner can split any group.
    """
    keys = [F.col(k) for k in by]
    # No partition count: the adaptive planner may merge adjacent ranges of a small input.
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The written copy pins each row to its range: a recomputed sort could draw other boundaries.
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id()))
    inside = Window.partitionBy("_range", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranged.groupBy("_range", *by).agg(F.sum(weight).alias("_w"))
    grp = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    slices = slices.select(
        "_range", *by,
        F.coalesce(F.sum("_w").over(grp.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_w").over(grp).alias("total"))
    ranged = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    matched = _null_safe(ranged, slices, ["_range", *by])
    return matched.withColumn("ahead", F.col("_inside") + F.col("_offset")).drop(
        "_range", "_pos", "_inside", "_offset")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join in which null keys match each other."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def row_number_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                        out: str = "rn", size: str = "group_size") -> DataFrame:
    """Exact row_number and group size. ``by`` + ``order`` must be a total order over the rows."""
    return (
        weight_before(df.withColumn("_one", F.lit(1).cast("long")), by, order, "_one")
        .withColumn(out, F.col("ahead") + 1)
        .withColumnRenamed("total", size)
        .drop("_one", "ahead")
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (group, value) with its number of rows, or the summed weight of its rows."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank of ``value`` inside each group (ties share the mean of their positions)."""
    counted = weight_before(value_counts(df, by, value), by, [F.col(value)], "_n")
    ranks = counted.select(*by, value, (F.col("ahead") + (F.col("_n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*by, value], "left")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per entry.

    ``weight`` names a column that says how many rows each row stands for.
    """
    counted = weight_before(value_counts(df, by, value, weight), by, [F.col(value)], "_n")
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("ahead") <= at) & (at < F.col("ahead") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
    wide = counted.groupBy(*by).agg(F.max("total").alias("_t"), *aggs)
    outs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_t") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return wide.select(*by, *outs)


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", weight: str | None = None) -> DataFrame:
    return exact_quantiles(df, by, value, {out: 0.5}, weight)
