import hashlib

import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from tidespine.plans import events as ev, filings as fl, macro as ma, market as mk

SPINE = "ticker string, date date"


def spine(spark, *days, ticker="A"):
    return spark.createDataFrame([(ticker, day(d)) for d in days], SPINE)


def test_threat_week_sums(spark):
    t = spark.createDataFrame([(day(0), "cve_critical", 3.0), (day(1), "cve_critical", 2.0), (day(8), "cve_critical", 2.0)], "date date, metric string, value double")
    out = by_key(ma.cyber_features(t), "date")
    assert [out[day(d)]["cve_critical_7d"] for d in (0, 1, 8)] == [3.0, 5.0, 2.0]
    assert out[day(1)]["cyber_threat_index_7d"] == 1.0 and out[day(8)]["cyber_threat_index_7d"] == pytest.approx(0.4)
    dense = by_key(ma.cyber_features(t, spark.createDataFrame([(day(5),)], "date date")), "date")
    assert dense[day(5)]["cve_critical_7d"] == 5.0


def test_two_articles_do_not_fan_out(spark):
    news = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", ["A", "B"], s) for d, s in ((2, 0.5), (3, 0.1))], "ts string, mentioned_tickers array<string>, net_sentiment double")
    news = news.withColumn("timestamp", F.to_timestamp("ts"))
    out = ev.sentiment_features(spine(spark, 4), news).first()
    assert out["article_count_7d"] == 2 and out["sentiment_mean_7d"] == pytest.approx(0.3) and out["ticker_vs_market_7d"] == pytest.approx(0.0)
    late = by_key(ev.attach_sentiment(spine(spark, 34, 35), ev.sentiment_features(spine(spark, 4), news)), "date")
    assert late[day(34)]["article_count_7d"] == 2 and late[day(35)]["article_count_7d"] == 0 and late[day(35)]["sentiment_mean_7d"] is None


def test_insider_windows_are_independent(spark):
    t = spark.createDataFrame([("A", day(0), "x", "P", 1e6), ("A", day(50), "x", "P", 2e6), ("A", day(55), "y", "S", 5e5), ("A", day(56), "z", "G", 9e9)],
                              "ticker string, transaction_date date, insider_name string, transaction_code string, value double")
    c = spark.createDataFrame([("A", day(10), "purchase", 1000.0), ("A", day(11), "sale", 3000.0), ("A", day(12), "exchange", 5.0)],
                              "ticker string, trade_date date, transaction_type string, amount_mid double")
    out = by_key(ev.insider_features(spine(spark, 60, 300), t, c), "date")
    r = out[day(60)]
    assert r["insider_cluster_buy_90d"] == 1 and r["insider_net_value_30d"] == pytest.approx(1.5) and r["insider_buy_sell_ratio_90d"] == pytest.approx(0.5)
    assert r["congress_net_buy_90d"] == pytest.approx(-0.002) and r["congress_trade_count_90d"] == 3
    assert all(out[day(300)][x] is None for x in ev.INSIDER_COLS)


def test_ownership_goldens(spark):
    h = [("c1", "2024Q1", day(90), 5), ("c2", "2024Q1", day(90), 3), ("c1", "2023Q4", day(0), 6), ("c1", "2024Q2", day(181), 9)]
    holdings = spark.createDataFrame([(c, q, d, "A", s * 1_000_000) for c, q, d, s in h], "cik string, quarter string, period_end date, ticker string, shares_held long")
    out = by_key(fl.ownership_features(holdings, spark.createDataFrame([("A", 10_000_000)], "ticker string, shares_outstanding long")), "quarter")
    r = out["2024Q1"]
    assert (r["inst_ownership_pct"], r["inst_holder_count"], r["inst_concentration_top10"]) == (80.0, 2, 1.0)
    assert r["inst_net_shares_qoq"] == pytest.approx(0.2) and out["2024Q2"]["inst_momentum_2q"] == pytest.approx(30.0)


def test_earnings_as_of_history(spark):
    e = spark.createDataFrame([("A", day(0), 1.0, 0.1), ("A", day(90), 1.0, 0.3), ("A", day(180), -1.0, None)], "ticker string, quarter_end date, eps_surprise double, eps_surprise_pct double")
    out = by_key(fl.attach_earnings(spine(spark, -1, 10, 100, 200), e), "date")
    assert out[day(-1)]["eps_beat_streak"] == 0 and out[day(10)]["eps_surprise_mean_4q"] == pytest.approx(0.1)
    assert out[day(100)]["eps_beat_streak"] == 2 and out[day(100)]["eps_surprise_mean_4q"] == pytest.approx(0.2)
    assert out[day(200)]["eps_surprise_last"] is None and out[day(200)]["eps_surprise_mean_4q"] == pytest.approx(0.2) and out[day(200)]["eps_beat_streak"] == 0


def test_capex_totals_need_four_quarters_everywhere(spark):
    q = [("A", day(91 * i), 100.0 * (i + 1), 10.0) for i in range(6)] + [("B", day(91 * i), 50.0, 5.0) for i in range(1, 6)]
    out = by_key(fl.trailing_totals(spark.createDataFrame(q, "ticker string, period_end date, revenue double, capex double"),
                                    spark.createDataFrame([(day(91 * 3),), (day(91 * 4),), (day(91 * 5 + 126),), (day(91 * 5 + 128),), (day(5000),)], "date date")), "date")
    assert out[day(273)]["revenue"] is None  # B has three quarters only
    assert out[day(364)]["revenue"] == 200 + 300 + 400 + 500 + 4 * 50.0 and out[day(364)]["capex"] == 60.0
    assert out[day(455 + 126)]["capex"] == 60.0 and out[day(455 + 128)]["capex"] is None  # the oldest of four leaves the window
    assert out[day(5000)]["revenue"] is None


def test_power_moat_cases(spark):
    zone = spark.createDataFrame([("ALL_VIRGINIA", day(0), 10.0), ("ALL_VIRGINIA", day(30), 30.0), ("ALL_VIRGINIA", day(60), 20.0), ("X", day(60), 99.0)], "zone string, date date, queue_backlog_gw double")
    cap = spark.createDataFrame([("nuclear", day(0), 20.0), ("natural_gas", day(0), 20.0), ("solar", day(0), 500.0)], "fuel_type string, date date, capacity_gw double")
    out = {d: r["us_power_moat_score"] for d, r in by_key(ma.power_moat(spine(spark, -1, 5, 40, 70), zone, cap), "date").items()}
    assert out == {day(-1): 0.0, day(5): 0.25, day(40): 1.0, day(70): 0.5}


def test_monthly_series(spark):
    macro = spark.createDataFrame([("CFNAI", day(0), 1.0), ("NEWORDER", day(0), 10.0), ("NEWORDER", day(365), 12.0)], "series_id string, date date, value double")
    out = by_key(ma.series_features(spine(spark, 60, 61, 400), macro, ma.PHYSICAL_SERIES), "date")
    assert out[day(60)]["phys_ai_cfnai_level"] == 1.0 and out[day(61)]["phys_ai_cfnai_level"] is None
    assert out[day(400)]["phys_ai_capgoods_orders_yoy"] == pytest.approx(0.2)
    assert len(ma.PHYSICAL_COLS) == 21


def test_option_features_small_chain(spark):
    d = day(0)
    chain = [("A", d, day(28), k, s, iv, 10, 5) for k in ("call", "put") for s, iv in ((90.0, 0.5), (100.0, 0.3), (110.0, 0.2))]
    chain += [("A", d, day(95), "call", 100.0, 0.25, 1, 1), ("A", d, day(28), "put", 92.0, 0.6, 30, 0), ("B", d, day(200), "call", 5.0, 0.1, 1, 1)]
    c = spark.createDataFrame(chain, "ticker string, date date, expiry date, option_type string, strike double, iv double, oi long, volume long")
    prices = spark.createDataFrame([("A", day(-i), 100.0 + i % 2) for i in range(40)], "ticker string, date date, close_price double")
    out = by_key(mk.option_features(c, prices), "ticker")
    a = out["A"]  # strikes 90 90 92 100 100 110 110: the median is 100
    assert a["iv_rank_30d"] == 50.0 and a["put_call_oi_ratio"] == pytest.approx(2.0) and a["put_call_vol_ratio"] == 1.0
    assert a["skew_otm"] == pytest.approx(0.6 - 0.2) and a["iv_term_slope"] == pytest.approx(0.05)
    assert a["iv_hv_spread"] < 0.3
    assert all(out["B"][x] == 0.0 for x in mk.OPTION_COLS)


def test_option_contracts_are_read_once(spark):
    c = spark.range(700).selectExpr("'A' AS ticker", "DATE'2024-01-01' + CAST(id % 60 AS INT) AS date", "DATE'2024-02-15' + CAST(id % 90 AS INT) AS expiry", "if(id % 2 = 0, 'put', 'call') AS option_type",
                                    "90.0D + id % 20 AS strike", "0.1D AS iv", "id AS oi", "id AS volume")
    prices = spark.createDataFrame([("A", day(i), 100.0 + i % 2) for i in range(40)], "ticker string, date date, close_price double")
    plan = mk.option_features(c, prices)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 700") == 1


def test_option_rows_of_days_without_a_usable_quote_are_zero(spark):
    chain = [("A", day(0), None, "call", 100.0, 0.3, 1, 1), ("B", day(0), day(28), "call", 0.0, 0.3, 1, 1), ("B", day(1), day(28), "call", None, 0.3, 1, 1), ("C", day(0), day(100), "call", 100.0, 0.3, 1, 1)]
    c = spark.createDataFrame(chain, "ticker string, date date, expiry date, option_type string, strike double, iv double, oi long, volume long")
    prices = spark.createDataFrame([("A", day(i), 100.0 + i % 2) for i in range(40)], "ticker string, date date, close_price double")
    out = mk.option_features(c, prices).collect()
    assert {(r["ticker"], r["date"]) for r in out} == {x[:2] for x in chain} and len(out) == len(chain)
    assert all(r[x] == 0.0 for r in out for x in mk.OPTION_COLS)


def test_layer_momentum_excludes_self_and_needs_peers(spark):
    r = spark.createDataFrame([(t, day(0), v) for t, v in (("A", 0.1), ("B", 0.2), ("C", 0.3), ("D", None), ("X", 0.9))], "ticker string, date date, ret_20d double")
    layers = spark.createDataFrame([(t, "l") for t in "ABCD"] + [("X", "m")], "ticker string, layer string")
    out = by_key(mk.layer_momentum(r, r, layers), "ticker")
    assert out["A"]["own_layer_momentum_20d"] == pytest.approx(0.25) and out["D"]["own_layer_momentum_20d"] == pytest.approx(0.2)
    assert out["X"]["own_layer_momentum_20d"] is None and out["X"]["ecosystem_momentum_20d"] is None


def test_correlation_peers_are_fixed_and_foreign(spark):
    layers = [(f"T{i:02d}", f"L{i % 3}") for i in range(60)] + [("ALONE", "L9")]
    df = spark.createDataFrame(layers, "ticker string, layer string")
    pairs = sorted(map(tuple, mk.correlation_peers(df).collect()))
    group = dict(layers)
    assert pairs == sorted(map(tuple, mk.correlation_peers(df.repartition(5)).collect())) and len(pairs) == len(set(pairs)) == 61 * 20
    assert all(group[a] != group[b] for a, b in pairs)
    ring = sorted(group, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for ticker in ("T00", "ALONE"):
        at = ring.index(ticker)
        others = [t for t in ring[at + 1:] + ring[:at] if group[t] != group[ticker]]
        assert sorted(p for t, p in pairs if t == ticker) == sorted(others[:20])
    assert mk.correlation_peers(df.where("layer = 'L1'")).count() == 0

def test_fx_return_only_for_foreign(spark):
    px = spark.createDataFrame([(t, day(i), 100.0 + i) for t in ("E", "U") for i in range(30)], "ticker string, date date, close_price double")
    cur = spark.createDataFrame([("E", "EUR", "EURUSD"), ("U", "USD", "USD")], "ticker string, currency string, pair string")
    rates = spark.createDataFrame([("EURUSD", day(i), 1.0 if i < 15 else 2.0) for i in range(30) if i != 25], "pair string, date date, rate double")
    out = by_key(mk.fx_features(px.select("ticker", "date"), px, cur, rates), "ticker", "date")
    assert out["U", day(25)]["fx_adjusted_return_20d"] is None and out["E", day(25)]["fx_adjusted_return_20d"] is None
    assert out["E", day(24)]["fx_adjusted_return_20d"] == pytest.approx(124 * 2 / 104 - 1)


def test_absent_sources_follow_the_null_policy(spark):
    from tidespine.plans import dataset as ds
    from tidespine.plans.price import price_features

    px = spark.createDataFrame([("A", day(i), 100.0 + i, 10) for i in range(3)], "ticker string, date date, close_price double, volume long")
    src = ds.Sources(px, spark.createDataFrame([("A", "l")], "ticker string, layer string"), spark.createDataFrame([], "ticker string, peer string"))
    r = ds.feature_matrix(price_features(px), src).where(F.col("date") == day(1)).first()
    assert len(ds.FEATURES) == 112 and set(ds.FEATURES) <= set(r.asDict())
    assert r["insider_net_value_30d"] is None and r["article_count_7d"] == 0 and r["cve_high_7d"] == 0.0 and r["patent_app_momentum"] == 0.0


def test_no_feature_sees_the_future(spark):
    """Adding later facts must not change earlier rows."""
    days = range(0, 120, 7)
    s = spine(spark, *days)
    cut = day(60)
    t = spark.createDataFrame([("A", day(i), f"p{i % 5}", "PS"[i % 2], float(i)) for i in range(120)], "ticker string, transaction_date date, insider_name string, transaction_code string, value double")
    c = spark.createDataFrame([], "ticker string, trade_date date, transaction_type string, amount_mid double")
    si = spark.createDataFrame([("A", day(i), (i % 9) / 10) for i in range(120)], "ticker string, date date, short_vol_ratio double")
    er = spark.createDataFrame([("A", day(i), float(i % 3 - 1), 0.1 * i) for i in range(0, 120, 15)], "ticker string, quarter_end date, eps_surprise double, eps_surprise_pct double")
    hq = spark.createDataFrame([("A", day(i), 10.0 * i, 1.0 * i) for i in range(0, 120, 10)], "ticker string, period_end date, revenue double, capex double")
    def until(df, c0):
        return df.where(F.col(c0) <= F.lit(cut))
    checks = [
        (ev.insider_features(s, t, c), ev.insider_features(s, until(t, "transaction_date"), c)),
        (ev.short_interest_features(s, si), ev.short_interest_features(s, until(si, "date"))),
        (fl.attach_earnings(s, er), fl.attach_earnings(s, until(er, "quarter_end"))),
        (fl.ai_economics_features(s, hq), fl.ai_economics_features(s, until(hq, "period_end"))),
    ]
    for full, part in checks:
        keep = lambda df: sorted(map(tuple, df.where(F.col("date") <= F.lit(cut)).collect()), key=repr)
        assert keep(full) == keep(part)


def test_priced_day_shortcut_equals_the_carried_path(spark):
    from tidespine.plans import dataset as ds
    from tidespine.plans.price import price_features

    px = spark.createDataFrame([(t, day(3 * i + (t == "B")), 100.0 + i, 10) for i in range(12) for t in "AB"], "ticker string, date date, close_price double, volume long")
    tables = {
        "insider_trades": spark.createDataFrame([("A", day(i), f"p{i % 3}", "PS"[i % 2], 1e5 * i) for i in range(30)], "ticker string, transaction_date date, insider_name string, transaction_code string, value double"),
        "congress_trades": spark.createDataFrame([("B", day(9), "sale", 5.0)], "ticker string, trade_date date, transaction_type string, amount_mid double"),
        "short_interest": spark.createDataFrame([("A", day(i), i / 50) for i in range(30)], "ticker string, date date, short_vol_ratio double"),
    }
    src = ds.Sources(px, spark.createDataFrame([("A", "l"), ("B", "m")], "ticker string, layer string"), spark.createDataFrame([], "ticker string, peer string"), tables)
    cols = [*ev.INSIDER_COLS, *ev.SHORT_COLS]
    fast, slow = (sorted(map(tuple, ds.feature_matrix(price_features(px), src, flag).select("ticker", "date", *cols).collect()), key=repr) for flag in (True, False))
    assert fast == slow
    one = ds.inference_matrix(src, str(day(18))).select("ticker", "date", *cols).collect()
    assert [tuple(one[0])] == [r for r in fast if r[1] == day(18)]
