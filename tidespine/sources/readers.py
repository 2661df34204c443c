"""Reading stored tables: typed scans, views, registry lookups, latest and per-entity reads."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyspark.sql.types import StructType

from tidespine.functions.scalar import any_not_null
from tidespine.schemas import empty, schema_of

# Columns and countries of the country energy file, and the cadence limits in days.
ENERGY_RENAMES = {"renewables_share_elec": "renewables_pct", "carbon_intensity_elec": "carbon_intensity_gco2_per_kwh"}
ENERGY_SIGNALS = ["renewables_share_elec", "solar_share_elec", "wind_share_elec", "nuclear_share_elec",
                  "electricity_demand", "per_capita_electricity", "carbon_intensity_elec"]
# Fixed values; the last two are added here, as the regions of the energy scores need them.
ENERGY_COUNTRIES = ["Norway", "Sweden", "Iceland", "Canada", "Japan", "United Arab Emirates", "Saudi Arabia", "Malaysia", "Indonesia", "Singapore",
                    "United States", "Morocco", "Germany", "France", "United Kingdom", "Netherlands", "South Korea"]
HORIZON_PREFERENCE = ["legacy", "252d"]


def _is_absent(exc: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc)


def scan(spark: SparkSession, path: str, table: str, base: str | None = None) -> DataFrame:
    """Parquet files under a path or glob with the declared schema; absent columns read as null.

    A missing source is a typed empty table, so downstream features become null or zero.
    """
    reader = spark.read.schema(schema_of(table))
    if base:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(path)
    except AnalysisException as exc:
        if _is_absent(exc):
            return empty(spark, table)
        raise


def read_partitions(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A partitioned table with declared types. Without them a folder ``horizon=20d`` reads as the number 20."""
    return spark.read.schema(schema).parquet(path)


def register_views(spark: SparkSession, views: dict[str, str]) -> list[str]:
    """Create a temp view per existing partitioned source, columns merged by name; returns their names."""
    made = []
    for name, path in views.items():
        try:
            df = spark.read.option("mergeSchema", "true").parquet(path)
        except AnalysisException as exc:
            if _is_absent(exc):
                continue
            raise
        df.createOrReplaceTempView(name)
        made.append(name)
    return made


def read_csv_table(spark: SparkSession, path: str, table: str, **constants: object) -> DataFrame:
    """CSV dimension with a declared schema; ``constants`` fills or overrides columns."""
    schema = schema_of(table)
    try:
        header = spark.read.option("header", True).csv(path)
    except AnalysisException as exc:
        if not _is_absent(exc):
            raise
        return empty(spark, table)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in header.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return header.select(*cols).withColumns({k: F.lit(v) for k, v in constants.items()})


def with_default(dim: DataFrame, keys: DataFrame, key: str, **defaults: object) -> DataFrame:
    """Rows of ``dim`` for the wanted keys; a key without rows gets one default row."""
    wanted = keys.select(key).distinct()
    out = wanted.join(dim, key, "left")
    missing = F.coalesce(*[F.col(c).isNotNull() for c in defaults])
    return out.withColumns({c: F.when(missing, F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()})


def country_energy(raw: DataFrame, countries: list[str] = ENERGY_COUNTRIES) -> DataFrame:
    """Text columns to typed signals for the listed countries; rows without any signal are dropped."""
    text = lambda c: F.when(~F.col(c).isin("", "NA"), F.col(c))
    df = raw.where(F.col("country").isin(countries)).select(
        "country", F.col("year").try_cast("int").alias("year"),
        *[text(c).try_cast("double").alias(ENERGY_RENAMES.get(c, c)) for c in ENERGY_SIGNALS])
    return df.where(any_not_null(*[ENERGY_RENAMES.get(c, c) for c in ENERGY_SIGNALS]))


def partition_values(spark: SparkSession, path: str, on: str = "date") -> DataFrame:
    """(on: string): the values of the first partition column of a stored table, from the names of its folders, one level deep; none where nothing is stored.

    What is listed has a row for each value, however many files they hold.
    """
    names = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{on}=*")
    found = names.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(names) or []
    values = [(unquote(s.getPath().getName().split("=", 1)[1]),) for s in found if s.isDirectory()]
    return spark.createDataFrame(sorted(values), f"{on} string")


def latest_partition(spark: SparkSession, path: str, on: str = "date") -> DataFrame:
    """Rows of the newest partition of a stored table. Its name comes from the listing; the scan reads that partition only."""
    newest = partition_values(spark, path, on).agg(F.max(on)).first()[0]
    table = spark.read.parquet(path)
    return table.where(F.col(on) == F.lit(newest).cast(table.schema[on].dataType))


def entity_history(df: DataFrame, ticker: str, on: str = "date") -> DataFrame:
    """Rows of one entity in date order. Of a table written by ``write_clustered`` only the row groups that hold it are read."""
    return df.where(F.col("ticker") == ticker).orderBy(on)


def last_rows(df: DataFrame, ticker: str, n: int, on: str = "date") -> DataFrame:
    """The newest n rows of one entity, in date order. Spark keeps n rows per task (top-n), not a full sort."""
    newest = df.where(F.col("ticker") == ticker).orderBy(F.col(on).desc()).limit(n)
    return newest.orderBy(on)


def preferred_predictions(preds: DataFrame, horizon: str | None = None) -> DataFrame:
    """Per date the explicit horizon, else legacy, else 252d, else the first horizon by name."""
    if horizon is not None:
        return preds.where(F.col("horizon") == horizon)
    order: Column = F.lit(len(HORIZON_PREFERENCE))
    for i, h in reversed(list(enumerate(HORIZON_PREFERENCE))):
        order = F.when(F.col("horizon") == h, F.lit(i)).otherwise(order)
    best = preds.groupBy("date").agg(F.min_by("horizon", F.struct(order, F.col("horizon"))).alias("horizon"))
    return preds.join(F.broadcast(best), ["date", "horizon"], "left_semi")


class Registry:
    """Lookups on the entity registry, a small dimension (ticker, layer, exchange, currency, country)."""

    def __init__(self, df: DataFrame, layer_order: list[str] | None = None):
        self.df, self.layer_order = df, layer_order

    def in_layer(self, layer: str) -> DataFrame:
        return self.df.where(F.col("layer") == layer).select("ticker").orderBy("ticker")

    def layers(self) -> DataFrame:
        """Layers in id order (the given order), or by name when no order is given."""
        names = self.df.select("layer").distinct()
        if not self.layer_order:
            return names.orderBy("layer")
        order = F.array(*[F.lit(x) for x in self.layer_order])
        return names.orderBy(F.array_position(order, F.col("layer")))

    def non_base(self, base: str = "USD") -> DataFrame:
        return self.df.where(F.col("currency") != base).select("ticker").orderBy("ticker")

    def listed_at(self, exchange: str = "US") -> DataFrame:
        return self.df.where(F.col("exchange") == exchange).select("ticker").orderBy("ticker")

    def currency_of(self, ticker: str) -> DataFrame:
        return self.df.where(F.col("ticker") == ticker).select("ticker", "currency")

    def layer_map(self) -> DataFrame:
        return self.df.select("ticker", "layer")
