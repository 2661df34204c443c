"""Streaming jobs replayed from files. Each runs to the end of the landed data and returns what it wrote."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidespine.catalog.base import query
from tidespine.functions.scalar import rounded
from tidespine.session import scratch_path
from tidespine.streaming import news as sn, positions as sp

c, lit = F.col, F.lit

_MSG = """ms AS (SELECT ts, user_id, event_id, CASE WHEN event_id % 11 <> 0 THEN latitude END AS lat, longitude AS lon, event_type FROM (SELECT ev.*, CAST(event_id % 60 - 10 AS DOUBLE) AS latitude, CAST(user_id * 7 % 180 - 40 AS DOUBLE) AS longitude FROM ev)),
 ps AS (SELECT ts AS timestamp, user_id::VARCHAR AS mmsi, lat AS latitude, lon AS longitude, CASE WHEN event_type = 'error' THEN CAST(user_id % 120 AS INTEGER) ELSE 0 END AS vessel_type,
 CASE WHEN lat BETWEEN 21.5 AND 25.5 AND lon BETWEEN 119.0 AND 122.5 THEN 'taiwan_strait' ELSE 'other' END AS corridor FROM ms WHERE lat IS NOT NULL AND (event_type <> 'error' OR user_id % 120 BETWEEN 70 AND 89))"""


def messages(t):
    """Events as vessel messages: errors are static reports, the others position reports; some lack coordinates."""
    static = c("event_type") == "error"
    lat = F.when(c("event_id") % 11 != 0, (c("event_id") % 60 - 10).cast("double"))
    lon = (c("user_id") * 7 % 180 - 40).cast("double")
    meta = F.struct(c("user_id").cast("string").alias("MMSI"), F.concat(lit("V"), "user_id").alias("ShipName"),
                    F.when(static, lat).alias("latitude"), F.when(static, lon).alias("longitude"))
    report = F.when(~static, F.struct(lat.alias("Latitude"), lon.alias("Longitude"), lit(1.0).alias("Sog"), lit(2.0).alias("Cog")))
    fixed = F.when(static, F.struct(lit("i").alias("ImoNumber"), (c("user_id") % 120).cast("int").alias("Type"), lit(3.0).alias("Draught"), lit("X").alias("Destination")))
    body = F.to_json(F.struct(meta.alias("MetaData"), F.struct(report.alias("PositionReport"), fixed.alias("ShipStaticData")).alias("Message")))
    return t.raw("events").select(body.alias("value"), c("ts").cast("timestamp").alias("arrival"))


def landed(t, copies=1):
    """Messages written in arrival order, split over files, for a file stream."""
    path = scratch_path(t.spark, "messages")
    rows = messages(t)
    for _ in range(copies):
        rows.repartitionByRange(4, "arrival").write.mode("append").parquet(path)
    return path


def stream(t, copies=1):
    return sp.parse_positions(sp.read_messages(t.spark, landed(t, copies)))


def drain(t, rows, label):
    """Run the append job to the end of its input and read the written table."""
    path = scratch_path(t.spark, label)
    sp.append_by_date(rows, path, scratch_path(t.spark, f"{label}-state")).awaitTermination()
    return t.spark.read.parquet(path)


@query("x01_position_stream", f"WITH {_MSG} SELECT timestamp::DATE AS day, mmsi, latitude, longitude, vessel_type FROM ps")
def x01(t):
    return drain(t, stream(t), "positions").select(F.to_date("timestamp").alias("day"), "mmsi", "latitude", "longitude", "vessel_type")


@query("x02_corridor_stream", f"WITH {_MSG} SELECT timestamp::DATE AS day, mmsi, corridor FROM ps")
def x02(t):
    return drain(t, stream(t), "corridors").select(F.to_date("timestamp").alias("day"), "mmsi", "corridor")


@query("x03_append_dates", f"WITH {_MSG} SELECT timestamp::DATE AS date, mmsi, longitude FROM ps")
def x03(t):
    return drain(t, stream(t), "dates").select("date", "mmsi", "longitude")


@query("x04_type_enrichment", f"""WITH {_MSG} SELECT CASE WHEN vessel_type > 0 THEN vessel_type ELSE CAST(mmsi::BIGINT % 120 AS INTEGER) END AS vessel_type, mmsi, timestamp::DATE AS day FROM ps""")
def x04(t):
    vessels = t.raw("events").select(c("user_id").cast("string").alias("mmsi"), (c("user_id") % 120).cast("int").alias("vessel_type")).distinct()
    return drain(t, sp.enrich_types(stream(t), vessels), "typed").select("vessel_type", "mmsi", F.to_date("timestamp").alias("day"))


_COUNTS = f"""WITH {_MSG}, p2 AS (SELECT timestamp::DATE AS d, mmsi, corridor FROM ps WHERE mmsi::BIGINT % 120 BETWEEN 70 AND 89),
 s AS (SELECT DISTINCT d - k AS start_day, corridor, mmsi FROM p2, (SELECT UNNEST(range(7))::INTEGER AS k)),
 f AS (SELECT start_day AS window_start, start_day + 7 AS window_end, corridor, COUNT(DISTINCT mmsi) AS vessels FROM s GROUP BY 1, 2, 3)
 SELECT * FROM f"""


def typed_batch(t):
    vessels = t.raw("events").select(c("user_id").cast("string").alias("mmsi"), (c("user_id") % 120).cast("int").alias("vessel_type")).distinct()
    return vessels, sp.cargo_counts(sp.enrich_types(sp.parse_positions(messages(t)), vessels))


def as_days(df):
    return df.withColumns({w: F.to_date(w) for w in ("window_start", "window_end")})


@query("x05_cargo_counts", _COUNTS)
def x05(t):
    return as_days(typed_batch(t)[1])


def streamed_counts(t, close=False):
    """The table a stream of counts has written; with ``close``, to the end of an input that has ended."""
    vessels, _ = typed_batch(t)
    source, path, state = landed(t), scratch_path(t.spark, "counts"), scratch_path(t.spark, "counts-state")
    rows = sp.enrich_types(sp.parse_positions(sp.read_messages(t.spark, source)), vessels)
    start = lambda: sp.write_counts(sp.cargo_counts(rows), path, state)
    if close:
        sp.drain_and_close(start, source, sp.closing_message(t.spark))
    else:
        start().awaitTermination()
    return t.spark.read.parquet(path)


@query("x05_cargo_counts_stream", _COUNTS + " WHERE window_end <= (SELECT MAX(timestamp) - INTERVAL 1 DAY FROM ps WHERE mmsi::BIGINT % 120 BETWEEN 70 AND 89)")
def x05_stream(t):
    return as_days(streamed_counts(t))


@query("x05_cargo_counts_drained", _COUNTS)
def x05_drained(t):
    return as_days(streamed_counts(t, close=True))


@query("x06_drop_redelivered", f"WITH {_MSG} SELECT DISTINCT mmsi, epoch_us(timestamp) AS at_us FROM ps")
def x06(t):
    return drain(t, sp.drop_redelivered(stream(t, copies=2), "60 days"), "once").select("mmsi", F.unix_micros("timestamp").alias("at_us"))


_SENTIMENT = """SELECT start_day AS window_start, start_day + 7 AS window_end, ticker, ROUND(AVG(net_sentiment), 6) AS sentiment_mean, ROUND(STDDEV_SAMP(net_sentiment), 6) AS sentiment_std, COUNT(net_sentiment) AS article_count
 FROM (SELECT day - k AS start_day, ticker, net_sentiment FROM tagged, (SELECT UNNEST(range(7))::INTEGER AS k)) GROUP BY 1, 2, 3"""


@query("x07_news_sentiment", _SENTIMENT)
def x07(t):
    return rounded(as_days(sn.rolling_sentiment(t.news)))


def streamed_sentiment(t, close=False):
    path, out, state = (scratch_path(t.spark, name) for name in ("articles", "sentiment", "sentiment-state"))
    t.news.select("timestamp", "mentioned_tickers", "net_sentiment").repartitionByRange(4, "timestamp").write.parquet(path)
    rows = t.spark.readStream.schema("timestamp timestamp, mentioned_tickers array<string>, net_sentiment double").parquet(path)
    start = lambda: sp.write_counts(sn.rolling_sentiment(rows), out, state)
    if close:
        sp.drain_and_close(start, path, sn.closing_article(t.spark))
    else:
        start().awaitTermination()
    return t.spark.read.parquet(out)


@query("x07_news_sentiment_stream", f"SELECT * FROM ({_SENTIMENT}) WHERE window_end <= (SELECT MAX(day) - INTERVAL 1 DAY FROM tagged)")
def x07_stream(t):
    return rounded(as_days(streamed_sentiment(t)))


@query("x07_news_sentiment_drained", _SENTIMENT)
def x07_drained(t):
    return rounded(as_days(streamed_sentiment(t, close=True)))
