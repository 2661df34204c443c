"""As-of and interval queries beside the same query as a plain range join, one JSON line."""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import Window, functions as F

from tidespine.catalog import QUERIES
from tidespine.catalog.views import Tables
from tidespine.session import local_session


def naive_asof(t):
    """Range join on the key, then the newest row per order."""
    o = t.ord.select("o_orderkey", "ticker", "day")
    joined = o.join(t.si, (o["ticker"] == t.si["ticker"]) & (o["day"] >= t.si["date"]), "left").drop(t.si["ticker"])
    newest = Window.partitionBy("o_orderkey").orderBy(F.col("date").desc())
    return joined.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "date")


def naive_interval(t):
    s, tr = t.px.select("ticker", "date").distinct(), t.tr.withColumnRenamed("ticker", "_k")
    on = (s["ticker"] == tr["_k"]) & tr["transaction_date"].between(F.date_sub("date", 90), F.col("date"))
    return s.join(tr, on, "left").groupBy("ticker", "date").agg(F.count_distinct("insider_name").alias("members"), F.sum("value").alias("total"))


def ours_interval(t):
    from tidespine.operators.intervals import Span, distinct_in_span, span_agg

    total = span_agg(t.px, t.tr, ["ticker"], "date", [Span("total", "sum", F.col("value"), -90)], facts_on="transaction_date")
    members = distinct_in_span(t.px, t.tr, ["ticker"], "date", "insider_name", 90, "members", facts_on="transaction_date")
    return total.join(members, ["ticker", "date"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench-naive", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    runs = {"asof_ours": lambda: QUERIES["j01_asof_by_key"](spark, sf_dir), "asof_range_join": lambda: naive_asof(Tables(spark, sf_dir)),
            "interval_ours": lambda: ours_interval(Tables(spark, sf_dir)), "interval_range_join": lambda: naive_interval(Tables(spark, sf_dir))}
    out = {}
    for name, make in runs.items():
        for _ in range(2):
            t0 = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "naive_comparison", "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
