"""Row-window operators on a (key, day) panel. One key holds at most one row per day."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def trailing(by: str | Sequence[str], on: str, rows: int):
    """The current row and ``rows`` rows before it."""
    by = [by] if isinstance(by, str) else list(by)
    return Window.partitionBy(*by).orderBy(on).rowsBetween(-rows, 0)


def full_sum(value: str, by: str, on: str, n: int) -> Column:
    """Sum of the last n rows, null until n non-null values are inside."""
    w = trailing(by, on, n - 1)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def full_mean(value: str, by: str, on: str, n: int) -> Column:
    w = trailing(by, on, n - 1)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def streak(df: DataFrame, value: str, by: str, on: str, out: str, max_len: int | None = None) -> DataFrame:
    """Length of the run of positive values that ends at each row; a null or <= 0 breaks it."""
    w = Window.partitionBy(by).orderBy(on)
    broken = F.when(F.col(value).isNull() | (F.col(value) <= 0), F.col("_rn"))
    run = F.col("_rn") - F.coalesce(F.max(broken).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    if max_len is not None:
        run = F.least(run, F.lit(max_len))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(out, run).drop("_rn")


def realised_volatility(df: DataFrame, price: str, by: str, on: str, out: str, n: int = 30,
                        tail: int = 35, periods: int = 252) -> DataFrame:
    """Sample deviation of the last n log returns among the last ``tail`` rows, annualised."""
    w = Window.partitionBy(by).orderBy(on)
    prev = F.lag(price).over(w)
    logret = F.when((prev > 0) & (F.col(price) > 0), F.ln(F.col(price) / prev))
    held = F.collect_list("_lr").over(w.rowsBetween(-(tail - 2), 0))  # at most tail-1 numbers
    used = F.slice(held, F.greatest(F.lit(1), F.size(held) - n + 1), F.lit(n))
    zero = F.lit(0.0)
    mean = F.aggregate("_used", zero, lambda acc, x: acc + x) / F.size("_used")
    squares = F.aggregate("_used", zero, lambda acc, x: acc + (x - F.col("_mu")) * (x - F.col("_mu")))
    return (df.withColumn("_lr", logret)
            .withColumn("_used", used)
            .withColumn("_mu", F.when(F.size("_used") >= 2, mean))
            .withColumn(out, F.when(F.size("_used") >= 2,
                                    F.sqrt(squares / (F.size("_used") - 1)) * F.sqrt(F.lit(float(periods)))))
            .drop("_lr", "_used", "_mu"))


def span_return(df: DataFrame, price: str, by: str, on: str, days: int, out: str) -> DataFrame:
    """Last / first price inside [d-days, d] minus one; needs two rows and a non-zero start."""
    w = Window.partitionBy(by).orderBy(F.unix_date(on)).rangeBetween(-days, 0)
    start = F.first(price).over(w)
    return df.withColumn(out, F.when(F.count(price).over(w) >= 2, F.try_divide(F.col(price), start) - 1))


def rolling_correlation(returns: DataFrame, pairs: DataFrame, value: str, length: int, min_overlap: int,
                        entity: str = "ticker", peer: str = "peer", idx: str = "idx") -> DataFrame:
    """(entity, peer, idx, corr, overlap): rolling Pearson correlation on the shared calendar.

    One row per calendar position the entity has; positions where either side is missing do not count.
    The frame counts calendar rows. Its sums are put together from blocks of ``length`` positions: the
    tail of the previous block plus the head of the current one. Each row is touched twice whatever the
    length, nothing is subtracted, and so no digits are lost. Values are centred first for the same reason.
    """
    stats = returns.groupBy(entity).agg(F.avg(value).alias("_mu"), F.min(idx).alias("_a"), F.max(idx).alias("_z"))
    # Dense positions make the tail of the previous block a plain lag; added rows drop out at the end.
    grid = stats.select(entity, "_mu", F.explode(F.sequence("_a", "_z")).alias(idx))
    known = returns.select(entity, idx, F.col(value).alias("_v"), F.lit(True).alias("_given"))
    dense = grid.join(known, [entity, idx], "left").select(entity, idx, "_given", (F.col("_v") - F.col("_mu")).alias("_x"))
    right = dense.where("_x is not null").select(F.col(entity).alias(peer), idx, F.col("_x").alias("_y"))
    rows = dense.join(pairs, entity).join(right, [peer, idx], "left")
    x, y = F.when(F.col("_y").isNotNull(), F.col("_x")), F.when(F.col("_x").isNotNull(), F.col("_y"))
    rows = rows.select(entity, peer, idx, "_given", x.alias("_x"), y.alias("_y"), F.floor(F.col(idx) / length).alias("_block"))
    rows = rows.repartition(entity, peer)
    x, y = F.col("_x"), F.col("_y")
    parts = {"n": F.when(x.isNotNull(), 1.0), "x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}
    block = Window.partitionBy(entity, peer, "_block")
    zero = F.lit(0.0)

    def sums(order):
        w = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.struct(*[F.coalesce(F.sum(e).over(w), zero).alias(k) for k, e in parts.items()])

    rows = rows.select(entity, peer, idx, "_given", "_block", sums(F.col(idx)).alias("_head"), sums(F.col(idx).desc()).alias("_tail"))
    along = Window.partitionBy(entity, peer).orderBy(idx)
    back = F.lag("_tail", length - 1).over(along)
    start = F.first(F.struct("_block", "_tail")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(entity, peer, idx, "_given", "_block", "_head", back.alias("_back"), start.alias("_start")).where("_given")
    # A frame that fills exactly one block is its head alone; otherwise it begins in the block before,
    # or with the first row of the series.
    whole = F.col(idx) % length == length - 1
    early = F.when(F.col("_start._block") < F.col("_block"), F.col("_start._tail"))
    before = F.when(~whole, F.coalesce("_back", early))
    rows = rows.withColumn("_before", before).select(
        entity, peer, idx, *[(F.col(f"_head.{k}") + F.coalesce(F.col(f"_before.{k}"), zero)).alias(f"_{k}") for k in parts])
    n = F.col("_n")
    xx, yy = n * F.col("_xx"), n * F.col("_yy")
    vx, vy = xx - F.col("_x") * F.col("_x"), yy - F.col("_y") * F.col("_y")
    cov = n * F.col("_xy") - F.col("_x") * F.col("_y")
    # A constant side leaves only rounding noise, far below its own sum of squares.
    varies = (vx > xx * 1e-12) & (vy > yy * 1e-12)
    return rows.select(entity, peer, idx, n.cast("long").alias("overlap"),
                       F.when((n >= min_overlap) & varies, cov / F.sqrt(vx * vy)).alias("corr"))


def rank_position(df: DataFrame, value: str, by: str, on: str, rows: int, min_rows: int, out: str,
                  neutral: float = 50.0) -> DataFrame:
    """Where the value sits between the trailing minimum and maximum, 0..100; neutral when undefined."""
    w = Window.partitionBy(by).orderBy(on)
    win = w.rowsBetween(-(rows - 1), 0)
    lo, hi = F.min(value).over(win), F.max(value).over(win)
    seen = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pos = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100))
    return df.withColumn(out, F.when((seen < min_rows) | (hi <= lo), F.lit(neutral)).otherwise(pos))
