import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from tidespine.operators import recent as rc
from tidespine.plans import dataset as ds
from tidespine.session import scratch_path
from tidespine.sources import readers as rd, sinks as sk


def scanned(df):
    """Rows that the scans of a collected query have read."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_reads_back_as_far_as_each_key_needs(spark):
    rng = random.Random(1)
    rows = [(t, day(i), i) for t, gap in (("a", 1), ("b", 7), ("c", 60), ("d", 400)) for i in range(1000) if i % gap == 0 or rng.random() < 0.01 and t == "c"]
    df = spark.createDataFrame(rows, "ticker string, date date, n int")
    keys = spark.createDataFrame([(t,) for t in ("a", "b", "c", "d", "new")], "ticker string")
    for at in (999, 500, 30):
        got = [tuple(r) for r in rc.recent(df, day(at), "date", keys, F.count(F.lit(1)) >= 5, 20).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(rows) and all(r[1] <= day(at) for r in got)
        for t in ("a", "b", "c", "d"):
            newest = sorted((r for r in rows if r[0] == t and r[1] <= day(at)), key=lambda r: r[1])[-5:]
            assert set(newest) <= set(got)
    assert len([r for r in rc.recent(df, day(999), "date", keys, F.count(F.lit(1)) >= 5, 20).collect() if r.ticker == "a"]) <= 21  # a full key is read no further
    assert rc.kth_day(df, day(999), "date", 5, 3) == day(995) and rc.kth_day(df.where("ticker = 'd'"), day(999), "date", 9, 3) == day(0)
    assert rc.kth_day(df.limit(0), day(5), "date", 3, 3) == day(5)


def test_cost_does_not_grow_with_history(spark):
    path = scratch_path(spark, "by-day")
    rows = spark.range(600).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.explode(F.array(*[F.lit(t) for t in "abcd"])).alias("ticker"))
    rows.repartition(1).write.partitionBy("date").parquet(path)
    table = rd.read_partitions(spark, path, "ticker string, date date")
    near = rc.between_days(table, "date", day(599), 30)
    assert scanned(near.groupBy("ticker").count()) == 4 * 31


def test_one_entity_reads_few_row_groups(spark):
    path = scratch_path(spark, "clustered")
    rows = spark.range(200_000).select(F.format_string("T%03d", F.col("id") % 500).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 500).cast("int")).alias("date"), F.rand(1).alias("x"))
    sk.write_clustered(rows, path, row_group=1 << 17)
    history = rd.entity_history(spark.read.parquet(path), "T123")
    assert history.count() == 400 and scanned(history) < 20_000
    assert history.select("date").collect() == sorted(history.select("date").collect())


def test_days_of_outputs_come_from_the_listing(spark):
    path = scratch_path(spark, "out")
    inputs = spark.createDataFrame([(day(i), i) for i in range(6)], "date date, n int")
    assert sk.unprocessed(inputs, path).count() == 6
    sk.write_dates(inputs.where("n in (1, 4)"), path)
    assert sorted(r.n for r in sk.unprocessed(inputs, path).collect()) == [0, 2, 3, 5]


def test_first_failure_is_raised(spark):
    done = []

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        rc.together({"a": lambda: done.append(1), "b": fails, "c": lambda: done.append(2)})
    assert sorted(done) == [1, 2]


def test_one_date_matrix_of_rarely_traded_entities(spark):
    """Every family from bounded sources equals the same family from whole history."""
    rng = random.Random(3)
    often = {"A": 1.0, "B": 0.9, "C": 0.5, "D": 0.12, "E": 0.8, "F": 0.7, "G": 0.6, "H": 0.05}
    n, today = 700, 699
    px = [(t, day(i), 50 + 10 * rng.random() + i / 50, rng.randrange(1, 100)) for t, p in often.items() for i in range(n) if rng.random() < p or i == today]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    some = lambda k: sorted(rng.sample(range(n), k))
    tickers = list(often)
    tables = {
        "insider_trades": frame([(t, day(i), f"p{rng.randrange(4)}", rng.choice("PSG"), 1e5 * rng.random()) for t in tickers for i in some(150)], "ticker string, transaction_date date, insider_name string, transaction_code string, value double"),
        "congress_trades": frame([(t, day(i), rng.choice(["purchase", "sale"]), 5.0) for t in tickers for i in some(60)], "ticker string, trade_date date, transaction_type string, amount_mid double"),
        "short_interest": frame([(t, day(i), rng.random()) for t in tickers for i in some(300)], "ticker string, date date, short_vol_ratio double"),
        "earnings": frame([(t, day(i), *(2 * [rng.choice([None, -0.1, 0.2, 0.3, 0.4]) if t != "B" else 0.5])) for t in tickers for i in range(5, n, 90)], "ticker string, quarter_end date, eps_surprise double, eps_surprise_pct double"),
        "fundamentals": frame([(t, day(i), *(rng.random() for _ in ds.FUNDAMENTAL_COLS)) for t in tickers for i in ((20,) if t == "C" else (100, 400, 650))], "ticker string, period_end date, " + ", ".join(f"{c} double" for c in ds.FUNDAMENTAL_COLS)),
        "holdings": frame([(f"c{k}", t, str(q), day(q), rng.randrange(1, 99)) for t in tickers for q in ((10, 50, 90) if t == "D" else (400, 500, 600)) for k in range(4)], "cik string, ticker string, quarter string, period_end date, shares_held long"),
        "shares": frame([(t, 1000) for t in tickers], "ticker string, shares_outstanding long"),
        "currencies": frame([(t, "EUR" if t in "AH" else "USD", "EURUSD") for t in tickers], "ticker string, currency string, pair string"),
        "fx": frame([("EURUSD", day(i), 1 + rng.random()) for i in range(n)], "pair string, date date, rate double"),
        "threats": frame([(day(i), rng.choice(["cve_critical", "cve_high", "cisa_kev", "otx_pulse"]), rng.random()) for i in [*some(200), today]], "date date, metric string, value double"),
        "deals": frame([(day(i), *rng.sample(tickers, 2), rng.choice(["power_purchase_agreement", "other"]), 0.5, 10.0, "hyperscaler") for i in some(200)], "date date, party_a string, party_b string, deal_type string, confidence double, deal_mw double, buyer_type string"),
        "edges": frame([(a, b, 1.0 + (a + b > "CC")) for a in tickers for b in tickers if a != b and rng.random() < 0.5], "ticker_from string, ticker_to string, edge_weight double"),
        "hubs": ["A"],
        "hyperscaler_q": frame([(t, day(i), 10.0 * i, 1.0 * i) for t in "AB" for i in range(3, n, 91)], "ticker string, period_end date, revenue double, capex double"),
        "options": frame([(t, day(i), day(i + e), rng.choice(["put", "call"]), 40.0 + 2 * rng.randrange(12), rng.choice([0.0, 0.2, 0.3]), 5, 7) for t in "ABCD" for i in [*range(0, n, 23), today] for e in (20, 40, 90) for _ in range(8)],
                         "ticker string, date date, expiry date, option_type string, strike double, iv double, oi long, volume long"),
    }
    layers = spark.createDataFrame([(t, "l1" if t < "E" else "l2") for t in tickers], "ticker string, layer string")
    peers = spark.createDataFrame([(a, b) for a in tickers for b in tickers if a != b], "ticker string, peer string")
    src = ds.Sources(frame(px, "ticker string, date date, close_price double, volume long"), layers, peers, tables)
    got = {r.ticker: r.asDict() for r in ds.inference_matrix(src, str(day(today))).collect()}
    known = ds.Sources(src.ohlcv, layers, peers, tables)
    full = ds.feature_matrix(ds.price_features(known.ohlcv, str(day(today))), known, priced_days=True).collect()
    assert len(got) == len(full) == len(tickers)
    for r in full:
        for c in ds.FEATURES:
            want = pytest.approx(r[c], rel=1e-7, abs=1e-9) if isinstance(r[c], float) else r[c]
            assert got[r.ticker][c] == want, (r.ticker, c)
