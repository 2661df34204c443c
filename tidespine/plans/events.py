"""Families fed by event logs: insider and congress trades, short volume, scored news."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidespine.functions.scalar import ratio
from tidespine.operators.asof import asof_join
from tidespine.operators.intervals import Span, distinct_in_span, span_agg

KEYS = ["ticker", "date"]
INSIDER_COLS = ["insider_cluster_buy_90d", "insider_net_value_30d", "insider_buy_sell_ratio_90d",
                "congress_net_buy_90d", "congress_trade_count_90d"]
SENTIMENT_COLS = ["sentiment_mean_7d", "sentiment_std_7d", "article_count_7d", "sentiment_momentum_14d",
                  "ticker_vs_market_7d"]
SHORT_COLS = ["short_vol_ratio_10d", "short_vol_ratio_30d", "short_ratio_momentum"]
SENTIMENT_TOLERANCE_DAYS = 30
SHORT_TOLERANCE_DAYS = 7


def insider_features(spine: DataFrame, trades: DataFrame, congress: DataFrame) -> DataFrame:
    """Distinct buyers, net value in millions, buy share and congress activity per (ticker, date).

    Every window is aggregated on its own, so one window's rows never multiply another's.
    """
    def signed(kind, buy, sell, amount):
        return F.when(F.col(kind) == buy, F.col(amount)).when(F.col(kind) == sell, -F.col(amount)).otherwise(F.lit(0.0))

    own = span_agg(spine, trades, ["ticker"], "date", [
        Span("_net", "sum", signed("transaction_code", "P", "S", "value"), -30),
        Span("_n30", "count", F.col("transaction_code"), -30),
        Span("_buys", "sum", F.when(F.col("transaction_code") == "P", 1).otherwise(0), -90),
        Span("_n90", "count", F.col("transaction_code"), -90)], facts_on="transaction_date")
    buyers = distinct_in_span(spine, trades.where(F.col("transaction_code") == "P"), ["ticker"], "date",
                              "insider_name", 90, "_buyers", facts_on="transaction_date")
    con = span_agg(spine, congress, ["ticker"], "date", [
        Span("_cnet", "sum", signed("transaction_type", "purchase", "sale", "amount_mid"), -90),
        Span("_cn", "count", F.col("transaction_type"), -90)], facts_on="trade_date")
    return own.join(buyers, KEYS, "left").join(con, KEYS, "left").select(
        *KEYS,
        F.nullif("_buyers", F.lit(0).cast("long")).alias("insider_cluster_buy_90d"),
        F.when(F.col("_n30") > 0, F.col("_net").cast("double") / 1e6).alias("insider_net_value_30d"),
        ratio("_buys", "_n90").alias("insider_buy_sell_ratio_90d"),
        F.when(F.col("_cn") > 0, F.col("_cnet").cast("double") / 1e6).alias("congress_net_buy_90d"),
        F.nullif("_cn", F.lit(0).cast("long")).alias("congress_trade_count_90d"))


def attach_insider(spine: DataFrame, features: DataFrame) -> DataFrame:
    return asof_join(spine, features, on="date", by=["ticker"], cols=INSIDER_COLS)


def short_interest_features(spine: DataFrame, short: DataFrame) -> DataFrame:
    """Mean short-volume ratio over 10 and 30 days and the change against the ten days before."""
    known = short.where(F.col("short_vol_ratio").isNotNull())
    value = F.col("short_vol_ratio")
    s = span_agg(spine, known, ["ticker"], "date", [
        Span("short_vol_ratio_10d", "avg", value, -10), Span("short_vol_ratio_30d", "avg", value, -30),
        Span("_prior", "avg", value, -20, -11)])
    return s.withColumn("short_ratio_momentum", F.col("short_vol_ratio_10d") - F.col("_prior")).drop("_prior")


def attach_short_interest(spine: DataFrame, features: DataFrame) -> DataFrame:
    return asof_join(spine, features, on="date", by=["ticker"], cols=SHORT_COLS,
                     tolerance_days=SHORT_TOLERANCE_DAYS)


def sentiment_features(spine: DataFrame, news: DataFrame) -> DataFrame:
    """Mean, deviation, count, momentum and distance from the market of a ticker's article scores."""
    articles = news.where(F.col("mentioned_tickers").isNotNull()).select(
        F.to_date("timestamp").alias("date"), "mentioned_tickers", "net_sentiment")
    tagged = articles.select("date", F.explode("mentioned_tickers").alias("ticker"), "net_sentiment")
    value = F.col("net_sentiment")
    s = span_agg(spine, tagged, ["ticker"], "date", [
        Span("sentiment_mean_7d", "avg", value, -7), Span("sentiment_std_7d", "stddev", value, -7),
        Span("article_count_7d", "count", value, -7), Span("_prior", "avg", value, -14, -8)])
    market = articles.groupBy("date").agg(F.avg("net_sentiment").alias("market"))
    m = span_agg(spine, market, [], "date", [Span("_market", "avg", F.col("market"), -7)])
    return s.join(F.broadcast(m), "date", "left").select(
        *KEYS, "sentiment_mean_7d", "sentiment_std_7d", "article_count_7d",
        (F.col("sentiment_mean_7d") - F.col("_prior")).alias("sentiment_momentum_14d"),
        (F.col("sentiment_mean_7d") - F.col("_market")).alias("ticker_vs_market_7d"))


def attach_sentiment(spine: DataFrame, features: DataFrame) -> DataFrame:
    """Stale matches become null, except the count, which is 0."""
    out = asof_join(spine, features, on="date", by=["ticker"], cols=SENTIMENT_COLS,
                    tolerance_days=SENTIMENT_TOLERANCE_DAYS)
    return out.withColumn("article_count_7d", F.coalesce("article_count_7d", F.lit(0).cast("long")))


def daily_news(news: DataFrame, day: str | None = None, history_days: int = 61) -> DataFrame:
    """Per day: mean, deviation, volume, label counts, and change against 7 and 30 rows earlier.

    Articles collapse to one row per day before the unpartitioned lag, so it runs over days only.
    """
    if day:
        news = news.where(F.to_date("timestamp") >= F.date_sub(F.lit(day).cast("date"), history_days))
    label = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    daily = news.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.avg("net_sentiment").alias("mean_sentiment"), F.stddev_samp("net_sentiment").alias("sentiment_dispersion"),
        F.count(F.lit(1)).alias("article_volume"), label("positive").alias("positive_count"),
        label("negative").alias("negative_count"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    out = daily.withColumns({
        f"sentiment_momentum_{n}d": F.col("mean_sentiment") - F.lag("mean_sentiment", n).over(w) for n in (7, 30)})
    return out.where(F.col("date") == F.lit(day).cast("date")) if day else out
