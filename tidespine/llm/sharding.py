"""Contiguous shards of near equal bytes, from prefix sums over range partitions. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidespine.llm.common import stored

LAW = "bytes"


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` runs of one global order, cut at equal byte targets.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus ``overhead``), text_crc32, shard and slot (place in the
    shard, gapless from 0). The order is (hash of text, crc32, size, doc_id), so equal texts stand side by side: a group of copies
    lies in one shard unless a cut falls inside it, and a group of many shards' size is cut like anything else, so sizes stay near
    equal. A row goes to the shard that holds its middle byte, so a shard's size differs from the target by less than the
    largest row. Null and empty texts are one group of ``overhead`` bytes each; null doc_ids come first within a group; rows alike
    in everything are interchangeable. A row longer than a target may leave a shard empty. Other columns are not read.

    Texts never move: the shuffled row is four numbers. The ranges are written before they are summed, since a range exchange that
    runs twice may draw other borders. Only one total per range and one number per shard are gathered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["h", "text_crc32", "size", "doc_id"]
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    ranges = stored(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "shard-ranges")

    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy("part")  # one row per range
    offsets = totals.select("part", (F.sum("bytes").over(in_order) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(in_order) - F.col("n")).alias("rows_before"),
                            F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*keys)
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranges.withColumns({"before": before, "n": F.row_number().over(inside)}).join(F.broadcast(offsets), "part")
    middle = F.col("bytes_before") + F.col("before") + F.expr("size div 2")
    placed = placed.select("doc_id", "size", "text_crc32", middle.alias("middle"), "total", (F.col("rows_before") + F.col("n") - 1).alias("row"))
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (middle * {shards}) div total) as int)")).drop("middle", "total")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
