"""Writing tables: partitioned sinks, upserts, snapshot guards and incremental runs."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidespine.functions.dates import half_year_start
from tidespine.operators.dedup import upsert
from tidespine.session import scratch_path
from tidespine.sources.readers import partition_values


def write_by(df: DataFrame, path: str, *parts: str, mode: str = "overwrite") -> None:
    """One folder per partition value; existing partitions not in ``df`` stay untouched.

    The rebalance hint lets the adaptive planner split a hot partition over several tasks and merge
    small ones into few files.
    """
    (df.hint("rebalance", *parts).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def write_per_entity(df: DataFrame, path: str) -> None:
    write_by(df, path, "ticker")


def write_entity_years(df: DataFrame, path: str, on: str = "date") -> None:
    write_by(df.withColumn("year", F.year(on)), path, "ticker", "year")


def write_dates(df: DataFrame, path: str, *more: str) -> None:
    write_by(df, path, "date", *more)


#: Bytes of a row group of a clustered table: small, so that a read of one entity skips most of a file.
ROW_GROUP = 4 << 20


def write_clustered(df: DataFrame, path: str, key: str = "ticker", on: str = "date", mode: str = "overwrite", row_group: int = ROW_GROUP) -> None:
    """A table for reads of one entity: dealt into ranges of (key, day) and sorted, in small row groups with a Bloom filter on the key.

    The bounds of a sorted row group, its page index and its filter tell whether it can hold an entity, so a read by ``key`` touches few row groups of few
    files. A hot entity spreads over as many ranges as its days need.
    """
    (df.repartitionByRange(key, on).sortWithinPartitions(key, on).write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", row_group).option("parquet.page.size", min(row_group, 64 << 10)).parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    """The whole table, replaced."""
    df.write.mode("overwrite").parquet(path)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], by: str) -> None:
    """Merge ``batch`` into the stored table partitioned ``by`` a column its keys determine; the last row per key wins.

    Only partitions the batch touches are read and written, and the others keep their files. The merged rows are written to the shared folder
    first and swapped in when the write commits, so a lost executor or a failed write leaves the old partitions or a whole copy.
    """
    batch = batch.withColumn(by, F.col(by).cast("string"))
    try:
        current = spark.read.schema(batch.schema).parquet(path)
        touched = [r[0] for r in batch.select(by).distinct().collect()]  # names of the partitions to write
        current = current.where(F.col(by).isin(touched))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        current = spark.createDataFrame([], batch.schema)
    aside = scratch_path(spark, "upsert")
    upsert(current, batch, keys).write.parquet(aside)
    merged = spark.read.schema(batch.schema).parquet(aside)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


PERIODS: dict[str, Callable[[str], Column]] = {
    "day": lambda c: F.col(c),
    "week": lambda c: F.trunc(c, "week").cast("date"),  # ISO weeks start on Monday
    "month": lambda c: F.trunc(c, "month"),
    "half_year": lambda c: half_year_start(c),
}


def missing_snapshots(wanted: DataFrame, existing: DataFrame, period: str, on: str = "date") -> DataFrame:
    """Wanted run dates whose period holds no stored snapshot yet."""
    key = PERIODS[period]
    have = existing.select(key(on).alias("_period")).distinct()
    return wanted.withColumn("_period", key(on)).join(have, "_period", "left_anti").drop("_period")


def stale(wanted: DataFrame, existing: DataFrame, period: str, on: str = "date") -> DataFrame:
    """The wanted dates the newest stored snapshot does not already cover (same period)."""
    key = PERIODS[period]
    newest = existing.agg(F.max(on).alias("_newest")).select(key("_newest").alias("_period"))
    return wanted.withColumn("_period", key(on)).join(F.broadcast(newest), "_period", "left_anti").drop("_period")


def guarded_write(spark: SparkSession, path: str, run_date: str, period: str,
                  extract: Callable[[], DataFrame]) -> bool:
    """Run the extract and write ``date=run_date`` unless the period is covered or nothing came back."""
    wanted = spark.range(1).select(F.lit(run_date).cast("date").alias("date"))
    existing = partition_values(spark, path).select(F.col("date").cast("date").alias("date"))
    newest = existing.agg(F.max("date").alias("date")).where("date is not null")
    if not newest.isEmpty() and stale(wanted, newest, period).isEmpty():
        return False
    batch = extract()
    if batch.isEmpty():
        return False
    write_dates(batch.withColumn("date", F.lit(run_date).cast("date")), path)
    return True


def unprocessed(inputs: DataFrame, outputs: DataFrame | str, on: str = "date") -> DataFrame:
    """Input rows of the days that have no output yet. ``outputs`` may be the path of a table partitioned by day: its days then come from the listing."""
    if isinstance(outputs, str):
        outputs = partition_values(inputs.sparkSession, outputs, on).select(F.col(on).cast("date").alias(on))
    done = outputs.select(on).distinct()  # one row a day
    return inputs.join(F.broadcast(done), on, "left_anti")


def newest_per_entity(stored: DataFrame, on: str = "filed_date", key: str = "ticker") -> DataFrame:
    return stored.groupBy(key).agg(F.max(on).alias("_since"))


def after_watermark(landed: DataFrame, stored: DataFrame, on: str = "filed_date", key: str = "ticker") -> DataFrame:
    """Landed rows on or after the newest stored date of their entity; unseen entities come whole."""
    since = newest_per_entity(stored, on, key)
    joined = landed.join(since, key, "left")
    return joined.where(F.col("_since").isNull() | (F.col(on) >= F.col("_since"))).drop("_since")


def lookback(df: DataFrame, run_date: str, days: int, on: str = "date") -> DataFrame:
    run = F.lit(run_date).cast("date")
    return df.where((F.col(on) >= F.date_sub(run, days)) & (F.col(on) <= run))


def combine_extracts(parts: Sequence[DataFrame], run_date: str | None = None, days: int | None = None,
                     on: str = "date") -> DataFrame:
    """Per-query or per-day extracts as one table, optionally bounded to the days before the run."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return lookback(out, run_date, days, on) if run_date and days else out
