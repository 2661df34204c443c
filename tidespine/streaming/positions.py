"""Vessel position stream: parse, filter, tag, enrich, deduplicate, count and append."""
from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidespine.functions.text import corridor

CARGO_TYPES = (70, 89)
#: Event time of a closing row: later than any event, so it moves the watermark past every window. Counts leave it out.
CLOSING = dt.datetime(9000, 1, 1)
MESSAGE = """MetaData struct<MMSI string, ShipName string, latitude double, longitude double, time_utc string>,
  Message struct<PositionReport struct<Latitude double, Longitude double, Sog double, Cog double>,
                 ShipStaticData struct<ImoNumber string, Type int, Draught double, Destination string>>"""


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed message files as a stream of (value, arrival)."""
    reader = spark.readStream.schema("value string, arrival timestamp")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def parse_positions(messages: DataFrame) -> DataFrame:
    """JSON messages to position rows. Works on streams and batches.

    Event time is the arrival time. A message without coordinates or without a cargo type or a position
    report is dropped.
    """
    m = messages.select("arrival", F.from_json("value", MESSAGE).alias("m")).select("arrival", "m.MetaData", "m.Message.*")
    lat = F.coalesce("MetaData.latitude", "PositionReport.Latitude")
    lon = F.coalesce("MetaData.longitude", "PositionReport.Longitude")
    cargo = F.coalesce(F.col("ShipStaticData.Type").between(*CARGO_TYPES), F.lit(False)) | F.col("PositionReport").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("float")
    return m.where(cargo & lat.isNotNull() & lon.isNotNull()).select(
        F.col("arrival").alias("timestamp"), text("MetaData.MMSI").alias("mmsi"), text("ShipStaticData.ImoNumber").alias("imo"),
        text("MetaData.ShipName").alias("vessel_name"), F.coalesce("ShipStaticData.Type", F.lit(0)).alias("vessel_type"),
        lat.alias("latitude"), lon.alias("longitude"), num("PositionReport.Sog").alias("speed_knots"),
        num("PositionReport.Cog").alias("course"), num("ShipStaticData.Draught").alias("draught"),
        text("ShipStaticData.Destination").alias("destination"), corridor(lat, lon).alias("corridor"))


def enrich_types(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    """Vessel type by id from a static table, because position messages carry none."""
    known = vessels.select("mmsi", F.col("vessel_type").alias("_known"))
    return positions.join(known, "mmsi", "left").withColumn(
        "vessel_type", F.when(F.col("vessel_type") > 0, F.col("vessel_type")).otherwise(F.coalesce("_known", F.lit(0)))).drop("_known")


def drop_redelivered(positions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (vessel, timestamp); state is kept only for the watermark delay."""
    if positions.isStreaming:
        return positions.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["mmsi", "timestamp"])
    return positions.dropDuplicates(["mmsi", "timestamp"])


def cargo_counts(positions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Distinct cargo vessels per corridor over 7 days, sliding daily; exact on streams and in batch.

    Sightings become one row per (window, corridor, vessel) first and are counted then. On a stream both steps keep state until the
    watermark passes the window's end, so a count appears once, when its window closes.
    """
    cargo = positions.where(F.col("vessel_type").between(*CARGO_TYPES))
    if positions.isStreaming:
        cargo = before_closing(cargo.withWatermark("timestamp", delay))
    seen = cargo.groupBy(F.window("timestamp", "7 days", "1 day").alias("w"), "corridor", "mmsi").agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy("w", "corridor").agg(F.count(F.lit(1)).alias("vessels")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "corridor", "vessels")


def append_by_date(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to date partitions exactly once; replays after a failure come from the checkpoint."""
    writer = (rows.withColumn("date", F.to_date("timestamp")).writeStream.format("parquet").outputMode("append")
              .partitionBy("date").option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def write_counts(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Finished windows appended as Parquet; a window is written once, when the watermark passes its end."""
    writer = (counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def before_closing(rows: DataFrame, on: str = "timestamp") -> DataFrame:
    """Rows without closing rows. The condition names the event time, so it stays behind the watermark, which has to see them."""
    return rows.where(F.col(on) < F.lit(CLOSING))


def closing_message(spark: SparkSession) -> DataFrame:
    """One message (value, arrival) that ends an input: a cargo position at ``CLOSING``."""
    value = json.dumps({"MetaData": {"MMSI": "", "latitude": 0.0, "longitude": 0.0}, "Message": {"ShipStaticData": {"Type": CARGO_TYPES[0]}}})
    return spark.createDataFrame([(value, CLOSING)], "value string, arrival timestamp")


def drain_and_close(start: Callable[[], StreamingQuery], landing: str, closing: DataFrame) -> None:
    """Run a windowed job to the end of an input that has ended: all that landed, then a closing row, from the same checkpoint.

    The first run leaves open windows in its state. The closing row moves the watermark past them, and the second run writes them from
    that state; nothing is read or counted again. A closed input takes no further rows: they would be late.
    """
    start().awaitTermination()
    closing.coalesce(1).write.mode("append").parquet(landing)
    start().awaitTermination()
