"""Rolling article sentiment per ticker on a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidespine.streaming.positions import CLOSING, before_closing


def closing_article(spark: SparkSession) -> DataFrame:
    """One article (timestamp, mentioned_tickers, net_sentiment) that ends an input."""
    return spark.createDataFrame([(CLOSING, [""], 0.0)], "timestamp timestamp, mentioned_tickers array<string>, net_sentiment double")


def rolling_sentiment(articles: DataFrame, delay: str = "1 day", length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Mean, deviation and count per (window, ticker); one article counts for each of its tickers. A closing article ends a stream and is left out."""
    rows = articles.select("timestamp", F.explode("mentioned_tickers").alias("ticker"), "net_sentiment")
    if articles.isStreaming:
        rows = before_closing(rows.withWatermark("timestamp", delay))
    return rows.groupBy(F.window("timestamp", length, slide).alias("w"), "ticker").agg(
        F.avg("net_sentiment").alias("sentiment_mean"), F.stddev_samp("net_sentiment").alias("sentiment_std"),
        F.count("net_sentiment").alias("article_count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ticker", "sentiment_mean", "sentiment_std", "article_count")
