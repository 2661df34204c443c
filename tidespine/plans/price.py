"""Price features and forward-return labels over a (ticker, date) panel."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidespine.functions.scalar import change, ratio
from tidespine.operators.windows import trailing

PRICE_COLS = ["return_1d", "return_5d", "return_20d", "sma_20_deviation", "volatility_20d", "volume_ratio"]
HORIZONS = {"5d": 5, "20d": 20, "65d": 65, "252d": 252, "756d": 756, "1260d": 1260, "2520d": 2520, "5040d": 5040}


def price_features(ohlcv: DataFrame, filter_date: str | None = None, history_days: int | None = None) -> DataFrame:
    """Returns over 1/5/20 rows, deviation from and dispersion around the trailing mean, volume ratio.

    The trailing frame is the current row and the 20 before it (21 rows). A single-date request filters
    after the windows; later rows are cut at the scan, because a date filter cannot move below a window.
    ``history_days`` also cuts earlier rows; leave it open unless every entity trades often enough.
    """
    if filter_date:
        day = F.lit(filter_date).cast("date")
        ohlcv = ohlcv.where(F.col("date") <= day)
        if history_days is not None:
            ohlcv = ohlcv.where(F.col("date") >= F.date_sub(day, history_days))
    rows = Window.partitionBy("ticker").orderBy("date")
    mean = trailing("ticker", "date", 20)
    avg_close = F.avg("close_price").over(mean)
    out = ohlcv.select(
        "ticker", "date",
        *[change("close_price", F.lag("close_price", n).over(rows)).alias(f"return_{n}d") for n in (1, 5, 20)],
        change("close_price", avg_close).alias("sma_20_deviation"),
        ratio(F.stddev_samp("close_price").over(mean), avg_close).alias("volatility_20d"),
        ratio("volume", F.avg(F.col("volume").cast("double")).over(mean)).alias("volume_ratio"))
    return out.where(F.col("date") == F.lit(filter_date).cast("date")) if filter_date else out


def daily_matrix(ohlcv: DataFrame, positions: DataFrame | None, news: DataFrame | None, day: str) -> DataFrame:
    """One date's price features plus two market-wide scalars over the seven days before it."""
    prices = price_features(ohlcv, day)
    d = F.lit(day).cast("date")
    before = (F.to_date("timestamp") >= F.date_sub(d, 7)) & (F.to_date("timestamp") < d)
    cargo = sentiment = None
    if positions is not None:
        seen = positions.where(before & (F.col("corridor") == "taiwan_strait") & F.col("vessel_type").between(70, 89))
        cargo = seen.agg(F.count_distinct("mmsi") / 7.0).scalar()
    if news is not None:
        sentiment = news.where(before).agg(F.coalesce(F.avg("net_sentiment"), F.lit(0.0))).scalar()
    prices = prices.withColumns({"taiwan_cargo_ratio": F.lit(1.0) if cargo is None else cargo,
                                 "sentiment_mean": F.lit(0.0) if sentiment is None else sentiment})
    return prices.withColumn("feature_date", F.lit(day))


def label_1y(ohlcv: DataFrame) -> DataFrame:
    """Simple return over the next 252 rows; rows without a future price are dropped."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = F.lead("close_price", 252).over(w)
    return (ohlcv.select("ticker", "date", change(ahead, "close_price").alias("label_return_1y"), ahead.alias("_a"))
            .where("_a is not null").drop("_a"))


def labels_all(ohlcv: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One label per horizon on one window; missing futures stay null."""
    w = Window.partitionBy("ticker").orderBy("date")
    return ohlcv.select("ticker", "date", *[
        change(F.lead("close_price", n).over(w), "close_price").alias(f"label_return_{tag}")
        for tag, n in horizons.items()])
