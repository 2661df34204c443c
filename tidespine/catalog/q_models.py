"""Evaluation, dataset assembly, model jobs and text scoring on the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidespine.catalog import q_features
from tidespine.catalog.base import ORACLE, query
from tidespine.functions.scalar import rounded
from tidespine.plans import dataset as ds, evaluate as evl, events as ev, filings as fl, macro as ma, market as mk, models as ml, scoring
from tidespine.plans.attach import KEYS
from tidespine.plans.price import PRICE_COLS
from tidespine.schemas import FUNDAMENTAL_COLS
from tidespine.session import cut_lineage

c, lit = F.col, F.lit


def sources(t) -> ds.Sources:
    """Every source role on the test tables."""
    t.store("px", "deals", "er", "fq", "zones", "capacity", "energy", "rates", "jolts", "trade", "obs")
    names = t.award_names
    px, deals = t.stored("px"), t.stored("deals")
    entity = F.concat(lit("NATION_"), F.regexp_extract("ticker", r"(\d+)", 1))
    return ds.Sources(ohlcv=px, layers=t.layers, peers=t.peers, tables={
        "fundamentals": _fundamentals(t), "insider_trades": t.tr, "congress_trades": t.cg, "scored_news": t.news, "short_interest": t.si,
        "earnings": t.stored("er"), "edges": _edges(deals), "deals": deals, "hubs": ["NATION_3", "NATION_7"],
        "holdings": t.hold.withColumn("ticker", entity), "shares": t.shares.withColumn("ticker", entity),
        "zone_queue": t.stored("zones"), "capacity": t.stored("capacity"), "country_energy": t.stored("energy"), "geo_exposure": t.exposure,
        "power_tickers": ["NATION_1", "NATION_2"], "currencies": t.currencies, "fx": t.stored("rates"), "threats": t.threats,
        "options": t.options.withColumn("ticker", entity), "awards": t.awards, "award_names": names, "queue": t.queue,
        "patent_apps": t.apps, "patent_grants": t.grants, "assignee_names": names.withColumnRenamed("awardee_name", "assignee_name"),
        "postings": t.postings, "jolts": t.stored("jolts"), "trade": t.stored("trade"), "observations": t.stored("obs"), "hyperscaler_q": t.stored("fq").select("ticker", "period_end", "revenue", "capex")})


def _fundamentals(t):
    from tidespine.plans.filings import derive_ratios, valuation

    return valuation(derive_ratios(t.stored("fq")), t.stored("px"))


def _edges(deals):
    from tidespine.operators.graph import decayed_edges

    return decayed_edges(deals, "2001-12-31")


@query("e01_model_agreement", """SELECT ticker, date, horizon, ROUND(CASE WHEN expected_annual_return <> 0 THEN ((sign(lgbm_return) = sign(expected_annual_return))::INTEGER + (sign(rf_return) = sign(expected_annual_return))::INTEGER
 + (sign(ridge_return) = sign(expected_annual_return))::INTEGER) / 3.0::DOUBLE END, 6) AS model_agreement FROM preds""")
def e01(t):
    return rounded(evl.model_agreement(t.preds).select("ticker", "date", "horizon", "model_agreement"))


@query("e02_liquidity", """SELECT p.ticker, p.date, p.horizon, cap AS market_cap_b, COALESCE(cap >= 1.0, FALSE) AS is_liquid FROM preds p LEFT JOIN (SELECT ticker, date, close_price / 1e5 AS cap FROM px WHERE ticker NOT LIKE '%5') x USING (ticker, date)""")
def e02(t):
    # some entities have no market value at all
    caps = t.px.where("ticker not like '%5'").select(*KEYS, (c("close_price") / 1e5).alias("market_cap_b"))
    return evl.liquidity(t.preds.select(*KEYS, "horizon"), caps, KEYS)


_PEER = """r AS (SELECT *, CAST(row_number() OVER (PARTITION BY date, horizon ORDER BY expected_annual_return DESC NULLS LAST, ticker) AS INTEGER) AS rank FROM preds),
 top AS (SELECT date, horizon, ticker FROM r WHERE rank <= 10),
 w AS (SELECT top.date, top.horizon, top.ticker, px.date AS pd, close_price / NULLIF(LAG(close_price) OVER (PARTITION BY top.date, top.horizon, top.ticker ORDER BY px.date), 0) - 1 AS ret FROM top JOIN px ON px.ticker = top.ticker AND px.date BETWEEN top.date - 90 AND top.date),
 v0 AS (SELECT *, COUNT(*) OVER (PARTITION BY date, horizon, ticker) AS n, row_number() OVER (PARTITION BY date, horizon, ticker ORDER BY pd DESC) AS pos FROM w WHERE ret IS NOT NULL), v AS (SELECT * FROM v0 WHERE n > 5),
 pr AS (SELECT a.date, a.horizon, a.ticker, b.ticker AS peer, COUNT(*) AS m, covar_pop(a.ret, b.ret) / NULLIF(sqrt(var_pop(a.ret) * var_pop(b.ret)), 0) AS cc FROM v a JOIN v b ON a.date = b.date AND a.horizon = b.horizon AND a.{at} = b.{at} AND a.ticker <> b.ticker GROUP BY 1, 2, 3, 4),
 k AS (SELECT date, horizon, COUNT(DISTINCT ticker) AS k FROM v GROUP BY 1, 2), mm AS (SELECT date, horizon, ticker, AVG(cc) AS mean FROM pr WHERE m >= 10 AND cc IS NOT NULL GROUP BY 1, 2, 3),
 pc AS (SELECT r.*, ROUND(CASE WHEN o.ticker IS NULL THEN NULL WHEN k = 1 THEN 0.0 ELSE mean END, 4) AS peer_correlation_90d
 FROM r LEFT JOIN (SELECT DISTINCT date, horizon, ticker FROM v) o USING (date, horizon, ticker) LEFT JOIN k USING (date, horizon) LEFT JOIN mm USING (date, horizon, ticker))"""
SETS = ["date", "horizon"]


@query("e03_peer_correlation", "WITH " + _PEER.format(at="pd") + " SELECT ticker, date, horizon, peer_correlation_90d FROM pc")
def e03(t):
    return evl.peer_correlation(t.preds, t.px, keys=SETS).select(*KEYS, "horizon", "peer_correlation_90d")


@query("e03_peer_correlation_positional", "WITH " + _PEER.format(at="pos") + " SELECT ticker, date, horizon, peer_correlation_90d FROM pc")
def e03_pos(t):
    return evl.peer_correlation(t.preds, t.px, positional=True, keys=SETS).select(*KEYS, "horizon", "peer_correlation_90d")


_ENRICHED = """, caps AS (SELECT ticker, MAX(close_price) / 2e5 AS cap FROM px GROUP BY 1)
 SELECT ticker, date, horizon, rank, expected_annual_return, lgbm_return, rf_return, ridge_return, ROUND(cap, 6) AS market_cap_b, COALESCE(cap >= 1.0, FALSE) AS is_liquid,
 ROUND(CASE WHEN expected_annual_return <> 0 THEN ((sign(lgbm_return) = sign(expected_annual_return))::INTEGER + (sign(rf_return) = sign(expected_annual_return))::INTEGER
 + (sign(ridge_return) = sign(expected_annual_return))::INTEGER) / 3.0::DOUBLE END, 6) AS model_agreement, peer_correlation_90d FROM pc LEFT JOIN caps USING (ticker)"""


def enriched(t, preds, positional):
    """Enrichment written by month and read back, as the job stores it."""
    from tidespine.session import scratch_path
    from tidespine.sources.sinks import write_by

    caps = t.px.groupBy("ticker").agg((F.max("close_price") / 2e5).alias("market_cap_b"))
    out = evl.enrich(evl.rank_predictions(preds, SETS), caps, t.px, positional, SETS)
    path = scratch_path(t.spark, "enriched")
    write_by(out.withColumn("month", F.trunc("date", "month")), path, "month")
    return rounded(t.spark.read.parquet(path).drop("month"), 6)


@query("e04_enrich", "WITH " + _PEER.format(at="pd") + _ENRICHED + " WHERE horizon = '20d'")
def e04(t):
    from tidespine.sources.readers import preferred_predictions

    return enriched(t, preferred_predictions(t.preds), False)


@query("e04_enrich_positional", "WITH " + _PEER.format(at="pos") + _ENRICHED)
def e04_pos(t):
    return enriched(t, t.preds, True)


@query("e05_score_predictions", """WITH x AS (SELECT p.*, i, o, xd, o / i - 1 AS y FROM preds p JOIN (SELECT ticker, date, close_price AS i, '5d' AS horizon, LEAD(close_price, 5) OVER w AS o, LEAD(date, 5) OVER w AS xd FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)
 UNION ALL SELECT ticker, date, close_price, '20d', LEAD(close_price, 20) OVER w, LEAD(date, 20) OVER w FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)) q USING (ticker, date, horizon) WHERE i > 0 AND o IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY expected_annual_return DESC, ticker) AS rn, COUNT(*) OVER (PARTITION BY date, horizon) AS n FROM x)
 SELECT date, horizon, COUNT(*) AS n_tickers, ROUND(covar_pop(expected_annual_return, y) / NULLIF(sqrt(var_pop(expected_annual_return) * var_pop(y)), 0), 4) AS ic, ROUND(AVG((sign(expected_annual_return) = sign(y))::INTEGER), 4) AS hit_rate,
 ROUND(AVG(y) FILTER (rn <= greatest(1, n // 10)), 4) AS top_decile_return, MIN(xd) AS first_exit, MAX(xd) AS last_exit FROM r GROUP BY 1, 2 HAVING COUNT(*) >= 10""")
def e05(t):
    return evl.score_predictions(t.preds, t.px)


@query("e06_rebalance_dates", "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, MIN(date) AS rebalance_date FROM panel GROUP BY 1, 2")
def e06(t):
    return evl.rebalance_dates(t.panel)


_IC = """rk AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY predicted) + (COUNT(*) OVER (PARTITION BY date, predicted) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY date ORDER BY actual) + (COUNT(*) OVER (PARTITION BY date, actual) - 1) / 2.0 AS ra FROM panel),
 ic AS (SELECT date, COUNT(*) AS n, covar_pop(rp, ra) / NULLIF(sqrt(var_pop(rp) * var_pop(ra)), 0) AS ic FROM rk GROUP BY 1 HAVING COUNT(*) >= 4),
 md AS (SELECT date, MEDIAN(predicted) AS m, COUNT(*) AS n FROM panel GROUP BY 1),
 hs AS (SELECT date, AVG(actual) FILTER (predicted >= m) AS a, AVG(actual) FILTER (predicted < m) AS b FROM panel JOIN md USING (date) WHERE n >= 4 GROUP BY 1)"""


@query("e07_spearman_ic", f"WITH {_IC} SELECT date, n, ROUND(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL")
def e07(t):
    return rounded(evl.spearman_ic(t.panel))


@query("e08_half_spread", f"WITH {_IC} SELECT date, (a > b)::INTEGER::DOUBLE AS hit, ROUND(a - b, 12) AS spread FROM hs WHERE a IS NOT NULL AND b IS NOT NULL")
def e08(t):
    return rounded(evl.half_spread(t.panel), 12)


@query("e09_ic_summary", f"""WITH {_IC}, i AS (SELECT COUNT(ic) AS months, AVG(ic) AS m, STDDEV_SAMP(ic) AS s FROM ic WHERE ic IS NOT NULL), h AS (SELECT AVG((a > b)::INTEGER) AS hr, AVG(a - b) AS sp FROM hs WHERE a IS NOT NULL AND b IS NOT NULL)
 SELECT months, ROUND(m, 6) AS mean_ic, ROUND(s, 6) AS ic_std, ROUND(CASE WHEN s > 0 THEN m / (s / sqrt(months)) ELSE 0.0 END, 6) AS ic_tstat, ROUND(hr, 6) AS hit_rate, ROUND(sp, 6) AS mean_spread FROM i, h""")
def e09(t):
    return rounded(evl.ic_summary(evl.spearman_ic(t.panel), evl.half_spread(t.panel)))


@query("e10_date_split", "SELECT split, COUNT(*) AS n, MIN(date) AS first_day, MAX(date) AS last_day FROM (SELECT *, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date BETWEEN DATE '1999-01-01' AND DATE '2000-03-31' THEN 'test' END AS split FROM panel) WHERE split IS NOT NULL GROUP BY 1")
def e10(t):
    return evl.date_split(t.panel, "1998-12-31", "1999-01-01", "2000-03-31").groupBy("split").agg(
        F.count(lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


_FOLDS = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
 fo AS (SELECT panel.*, idx, CASE WHEN idx >= n - 756 THEN CAST((idx - (n - 756)) // 252 + 1 AS INTEGER) END AS fold FROM panel JOIN cal USING (date)),
 va AS (SELECT * FROM fo WHERE fold IS NOT NULL),
 gm AS (SELECT fold, layer, COUNT(*) AS n, ROUND(corr(predicted, actual), 4) AS ic, ROUND(AVG((sign(predicted) = sign(actual))::INTEGER), 4) AS hit_rate FROM va GROUP BY 1, 2 HAVING COUNT(*) >= 10),
 fm AS (SELECT fold, MIN(date) AS test_start, MAX(date) AS test_end, COUNT(*) AS n_samples, ROUND(corr(predicted, actual), 4) AS ic, ROUND(AVG((sign(predicted) = sign(actual))::INTEGER), 4) AS hit_rate,
 ROUND(AVG(actual) FILTER (predicted >= q), 4) AS top_decile_return FROM va JOIN (SELECT fold, quantile_cont(predicted, 0.9) AS q FROM va GROUP BY 1) USING (fold) GROUP BY 1)"""


def _validation(t):
    return evl.walk_forward(t.panel, 252).where("fold is not null")


@query("e11_walk_forward", f"WITH {_FOLDS} SELECT ticker, date, CAST(idx AS INTEGER) AS position, fold FROM fo")
def e11(t):
    return evl.walk_forward(t.panel, 252).select("ticker", "date", "position", "fold")


@query("e12_fold_metrics", f"WITH {_FOLDS} SELECT * FROM fm")
def e12(t):
    return evl.fold_metrics(_validation(t))


@query("e13_group_metrics", f"WITH {_FOLDS} SELECT * FROM gm")
def e13(t):
    return evl.group_metrics(_validation(t))


@query("e14_entity_accuracy", f"""WITH {_FOLDS}, a AS (SELECT fold, ticker, layer, AVG(predicted) AS p, AVG(actual) AS y, COUNT(*) AS n FROM va GROUP BY 1, 2, 3)
 SELECT a.fold, ticker, layer, ROUND(p, 6) AS predicted_return, ROUND(y, 6) AS actual_return, n AS n_observations, CAST(sign(p) AS INTEGER) AS predicted_direction, CAST(sign(y) AS INTEGER) AS actual_direction, sign(p) = sign(y) AS correct, test_start, test_end FROM a JOIN fm USING (fold)""")
def e14(t):
    return rounded(evl.entity_accuracy(_validation(t)))


@query("e15_fold_summary", f"""WITH {_FOLDS} SELECT ROUND(AVG(ic), 4) AS mean_ic, ROUND(AVG(hit_rate), 4) AS mean_hit_rate, ROUND(AVG(top_decile_return), 4) AS mean_top_decile_return,
 (SELECT layer FROM gm WHERE fold = 3 ORDER BY ic DESC, layer DESC LIMIT 1) AS best_layer, (SELECT layer FROM gm WHERE fold = 3 ORDER BY ic, layer LIMIT 1) AS worst_layer FROM fm""")
def e15(t):
    v = _validation(t)
    return evl.fold_summary(evl.fold_metrics(v), evl.group_metrics(v))


@query("e16_freshness", """SELECT source, latest, CAST(DATE '2001-08-20' - latest AS INTEGER) AS age_days, CASE WHEN latest IS NULL THEN 'MISSING' WHEN DATE '2001-08-20' - latest > lim THEN 'STALE' ELSE 'OK' END AS status
 FROM (SELECT 'prices' AS source, MAX(date) AS latest, 3 AS lim FROM px UNION ALL SELECT 'earnings', MAX(quarter_end), 60 FROM er UNION ALL SELECT 'energy', make_date(MAX(year), 1, 1), 999 FROM energy UNION ALL SELECT 'absent', NULL, 10)""")
def e16(t):
    return evl.freshness([("prices", t.px, "date", "daily"), ("earnings", t.er, "quarter_end", "monthly"), ("energy", t.energy, "year", "quarterly"),
                          ("absent", None, "date", "weekly")], "2001-08-20")


# ---- datasets ----------------------------------------------------------------------------------------


#: Decimals a family's own query compares; the others compare six.
DIGITS = dict.fromkeys(ev.INSIDER_COLS, 9) | dict.fromkeys(ev.SHORT_COLS, 12) | dict.fromkeys(mk.SUPPLY_COLS, 5) | dict.fromkeys([*ma.GOV_TICKER_COLS, "gov_ai_spend_30d"], 2)


def compared(df, cols):
    """Every feature of every row, each rounded as its family's query rounds it."""
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *[F.round(x, DIGITS.get(x, 6)).alias(x) if kinds[x] == "double" else c(x) for x in cols])


def _matrix_sql(spine: str, label: str = "") -> str:
    """The whole matrix in SQL: the families' own statements joined on one spine, with the null policy of the assembly."""
    entity = r"'NATION_' || regexp_extract(ticker, '(\d+)', 1)"
    renamed = lambda view: f"(SELECT * REPLACE ({entity} AS ticker) FROM {view})"
    keyed = [("f03_fundamentals", FUNDAMENTAL_COLS), ("f04_insider", ev.INSIDER_COLS), ("f07_short_interest", ev.SHORT_COLS), ("f08_earnings", fl.EARNINGS_COLS),
             ("f09_graph", mk.GRAPH_COLS + mk.DEAL_COLS), ("f12_supply_chain", mk.SUPPLY_COLS), ("f13_fx", mk.FX_COLS)]
    zeroed = [("f11_energy_geo", ma.ENERGY_COLS), ("f16_gov_ticker", ma.GOV_TICKER_COLS), ("f17_patents", ma.PATENT_COLS)]
    by_day = [("f20_physical_ai", ma.PHYSICAL_COLS), ("f21_ai_economics", fl.AI_ECONOMICS_COLS)]
    by_day_zeroed = [("f14_cyber", ma.CYBER_COLS), ("f16_gov_market", ma.GOV_MARKET_COLS), ("f18_labor", ma.LABOR_COLS), ("f19_trade", ma.TRADE_COLS)]
    special = {
        "f11_energy_geo": ORACLE["f11_energy_geo"].replace("('NATION_1', 'NATION_2', 'NATION_12')", "('NATION_1', 'NATION_2')"),
        "f18_labor": ORACLE["f18_labor"].replace("SELECT day AS date FROM ev UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem", "SELECT date FROM px")}
    owned = q_features._OWN.replace("FROM hold", f"FROM {renamed('hold')}").replace("LEFT JOIN shares", f"LEFT JOIN {renamed('shares')}")
    owned = f"WITH {owned} SELECT b.ticker, b.date, own.* EXCLUDE (ticker, quarter, period_end) FROM (SELECT ticker, date FROM px) b ASOF LEFT JOIN own ON b.ticker = own.ticker AND b.date >= own.period_end"
    options = ORACLE["f15_options"]
    options = options[options.index("ex AS (SELECT DISTINCT"):].replace("FROM options", f"FROM {renamed('options')}").replace("FROM bpx", "FROM px")
    parts, cols = [], []

    def add(name, sql, names, on, zero):
        parts.append(f"LEFT JOIN ({sql}) {name} USING ({on})")
        cols.extend(f"CAST(COALESCE({name}.{x}, 0) AS DOUBLE) AS {x}" if zero else f"{name}.{x}" for x in names)

    for on, group, zero in (("ticker, date", keyed, False), ("ticker, date", zeroed, True), ("date", by_day, False), ("date", by_day_zeroed, True)):
        for name, names in group:
            add(name, special.get(name, ORACLE[name]), names, on, zero)
    add("f10_ownership", owned, fl.OWNERSHIP_COLS, "ticker, date", False)
    add("f15_options", "WITH " + options, mk.OPTION_COLS, "ticker, date", True)
    prices = ", ".join(f"ROUND(pf.{x}, 6) AS {x}" for x in PRICE_COLS)
    news = ", ".join("CAST(0 AS BIGINT) AS article_count_7d" if x == "article_count_7d" else f"NULL::DOUBLE AS {x}" for x in ev.SENTIMENT_COLS)  # the news is years younger than the prices
    return f"SELECT pf.ticker, pf.date, {prices}, {news}, {', '.join(cols)}{label} FROM pf {spine} " + " ".join(parts)


@query("f23_training_dataset", _matrix_sql(f"JOIN ({ORACLE['f22_label_1y']}) f22 USING (ticker, date)", ", f22.label_return_1y"))
def f23(t):
    return compared(ds.training_dataset(sources(t)), [*ds.FEATURES, "label_return_1y"])


@query("f24_inference_matrix", f"SELECT * FROM ({_matrix_sql('')}) WHERE date = DATE '1999-06-15'")
def f24(t):
    return compared(ds.inference_matrix(sources(t), "1999-06-15"), ds.FEATURES)


@query("p24_tier_columns", """WITH l AS (SELECT ticker, date, LEAD(close_price, 5) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close_price, 0) - 1 AS y FROM px)
 SELECT pf.ticker, pf.date, ROUND(return_1d, 6) AS return_1d, ROUND(volume_ratio, 6) AS volume_ratio, NULL::DOUBLE AS insider_net_value_30d, CAST(0 AS BIGINT) AS article_count_7d, 0.0::DOUBLE AS cve_critical_7d, ROUND(y, 6) AS label_return
 FROM pf JOIN l ON l.ticker = pf.ticker AND l.date = pf.date WHERE y IS NOT NULL""")
def p24(t):
    bare = ds.Sources(ohlcv=t.px, layers=t.layers, peers=t.peers)
    df = ds.training_dataset(bare, horizon="5d")
    assert set(df.columns) == {*KEYS, *ds.TIERS["short"], "label_return"}
    return rounded(df.select(*KEYS, "return_1d", "volume_ratio", "insider_net_value_30d", "article_count_7d", "cve_critical_7d", "label_return"))


# ---- models ------------------------------------------------------------------------------------------


@query("m01_median_impute", """WITH m AS (SELECT MEDIAN(return_1d) AS a, MEDIAN(return_5d) AS b, MEDIAN(return_20d) AS c FROM pf) SELECT ticker, date, ROUND(COALESCE(return_1d, a), 9) AS return_1d, ROUND(COALESCE(return_5d, b), 9) AS return_5d, ROUND(COALESCE(return_20d, c), 9) AS return_20d FROM pf, m""")
def m01(t):
    from tidespine.plans.price import price_features

    f = price_features(t.stored("px")).select(*KEYS, "return_1d", "return_5d", "return_20d")
    return rounded(ml.impute(f, ml.medians(f, ["return_1d", "return_5d", "return_20d"])), 9)


@query("m02_standardise", """WITH s AS (SELECT AVG(close_price) AS m, STDDEV_POP(close_price) AS d, AVG(volume) AS vm, STDDEV_POP(volume) AS vd FROM px) SELECT ticker, date, ROUND((close_price - m) / d, 6) AS z_price, ROUND((volume - vm) / vd, 6) AS z_volume FROM px, s""")
def m02(t):
    out = ml.scale(t.px, ml.scale_fit(t.px, ["close_price", "volume"]), "z_")
    return rounded(out.select(*KEYS, c("z_close_price").alias("z_price"), "z_volume"))


def matrix(t, horizon):
    """All features of the horizon's tier and its label, stored: the rows the models train on."""
    return ds.training_datasets(sources(t), [horizon])[horizon], ds.TIERS[ds.TIER_OF_HORIZON[horizon]]


@query("m03_m04_m05_ensemble")
def m03(t):
    df, features = matrix(t, "65d")
    return rounded(ml.train_in_sample(df, features, "label_return").predict(df).select(
        *KEYS, "lgbm_return", "rf_return", "ridge_return", "expected_annual_return", "confidence_low", "confidence_high"))


_NNLS = """WITH g AS (SELECT SUM(p1*p1) AS aa, SUM(p1*p2) AS ab, SUM(p2*p2) AS bb, SUM(p1*y) AS ay, SUM(p2*y) AS cy FROM (SELECT l_quantity AS p1, l_discount * 1000 AS p2, l_extendedprice / 1000 AS y FROM lineitem)),
 s AS (SELECT *, (bb*ay - ab*cy) / (aa*bb - ab*ab) AS wa, (aa*cy - ab*ay) / (aa*bb - ab*ab) AS wb FROM g), w AS (SELECT CASE WHEN wa >= 0 AND wb >= 0 THEN wa WHEN ay*ay/aa >= cy*cy/bb THEN ay/aa ELSE 0 END AS a,
 CASE WHEN wa >= 0 AND wb >= 0 THEN wb WHEN ay*ay/aa >= cy*cy/bb THEN 0 ELSE cy/bb END AS b FROM s)"""


@query("m06_blend_weights", _NNLS + " SELECT 'p1' AS model, ROUND(a / (a + b), 6)::DOUBLE AS weight FROM w UNION ALL SELECT 'p2', ROUND(b / (a + b), 6)::DOUBLE FROM w")
def m06(t):
    df = t.raw("lineitem").select(c("l_quantity").alias("p1"), (c("l_discount") * 1000).alias("p2"), (c("l_extendedprice") / 1000).alias("y"))
    return rounded(t.spark.createDataFrame(list(ml.blend_weights(df, ["p1", "p2"], "y", (0.5, 0.5)).items()), "model string, weight double"))


@query("m07_walk_forward_training")
def m07(t):
    df, features = matrix(t, "20d")
    _, oof = ml.train(df, features, "label_return", 252)
    return evl.fold_metrics(oof)


GROUP_HORIZONS = ["20d", "65d"]


def trained_groups(t):
    """Models of every group and two horizons on the whole matrix. Two groups are trained first, then the run is resumed: (report, folder of the models)."""
    from tidespine.session import scratch_path

    root, sets = scratch_path(t.spark, "models"), ds.training_datasets(sources(t), GROUP_HORIZONS)
    pairs = t.layers.select("layer", F.explode(F.array(*map(lit, GROUP_HORIZONS))).alias("horizon")).distinct()
    rows = lambda layer, h: (sets[h].join(F.broadcast(t.layers.where(c("layer") == layer)), "ticker", "left_semi"), ds.TIERS[ds.TIER_OF_HORIZON[h]])
    first = ml.train_groups(rows, pairs.where("layer in ('ASIA', 'EUROPE')"), pairs.limit(0), root)
    done = ml.finished_pairs(t.spark, root)
    return first + ml.train_groups(rows, pairs, done, root), root


_GROUP_ROWS = """SELECT layer, '{h}d' AS horizon, COUNT(*) AS n FROM (SELECT pf.ticker, pf.date, LEAD(close_price, {h}) OVER (PARTITION BY px.ticker ORDER BY px.date) / NULLIF(close_price, 0) - 1 AS y
 FROM px JOIN pf ON pf.ticker = px.ticker AND pf.date = px.date) JOIN nat USING (ticker) WHERE y IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 100"""


@query("m08_group_training", " UNION ALL ".join(_GROUP_ROWS.format(h=h[:-1]) for h in GROUP_HORIZONS))
def m08(t):
    return t.spark.createDataFrame(trained_groups(t)[0], "layer string, horizon string, n long")


@query("m09_predict_and_rank")
def m09(t):
    report, root = trained_groups(t)
    today = cut_lineage(ds.inference_matrix(sources(t), "2001-05-15"))
    parts = []
    for h in GROUP_HORIZONS:
        models = {layer: ml.Ensemble.load(t.spark, f"{root}/layer={layer}/horizon={horizon}") for layer, horizon, _ in report if horizon == h}
        parts.append(ml.predict_groups(today, t.layers, models, h, "2001-05-15"))
    return rounded(parts[0].unionByName(parts[1]))


@query("m10_backtest")
def m10(t):
    df, features = matrix(t, "20d")
    return rounded(ml.backtest(df, features, "label_return", "1999-12-31", "2000-01-01", "2001-03-31"))


@query("m11_importances")
def m11(t):
    df, features = matrix(t, "65d")
    return rounded(ml.importances(ml.fit(df, features, "label_return", band=False), t.spark))


LEX_POS, LEX_NEG = ["the", "le", "der"], ["and", "est", "ist", "que"]


def _lexicon_sql() -> str:
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
    inside = lambda ws: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in ws) + ")))"
    return f"""WITH a AS (SELECT doc_id, {words} AS w FROM documents), s AS (SELECT doc_id, {inside(LEX_POS)} / greatest(len(w), 1)::DOUBLE AS p, {inside(LEX_NEG)} / greatest(len(w), 1)::DOUBLE AS n FROM a)
 SELECT doc_id, ROUND(p, 9) AS positive, ROUND(n, 9) AS negative, ROUND(1.0 - p - n, 9) AS neutral, ROUND(p - n, 9) AS net_sentiment,
 CASE WHEN p >= n AND p >= 1.0 - p - n THEN 'positive' WHEN n >= 1.0 - p - n THEN 'negative' ELSE 'neutral' END AS label FROM s"""


@query("m12_lexicon_scores", _lexicon_sql())
def m12(t):
    out = scoring.lexicon_scores(t.raw("documents").select("doc_id", "text"), "text", LEX_POS, LEX_NEG)
    return rounded(out.select("doc_id", *scoring.SCORE_COLS), 9)


_TRAINED = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS w, CASE WHEN quality > toxic THEN 'positive' WHEN quality < toxic THEN 'negative' WHEN quality = toxic THEN 'neutral' END AS y FROM documents LEFT JOIN labels USING (doc_id)),
 k AS (SELECT y, unnest(w) AS word FROM d WHERE y IS NOT NULL AND doc_id % 5 <> 0),
 n AS (SELECT word, COUNT(*) FILTER (WHERE y = 'positive') AS p, COUNT(*) FILTER (WHERE y = 'negative') AS n, COUNT(*) FILTER (WHERE y = 'neutral') AS u FROM k GROUP BY 1),
 s AS (SELECT SUM(p) AS tp, SUM(n) AS tn, SUM(u) AS tu, COUNT(*) AS v FROM n),
 m AS (SELECT word, ln((p + 1) / (tp + v)) AS p, ln((n + 1) / (tn + v)) AS n, ln((u + 1) / (tu + v)) AS u FROM n, s
  UNION ALL SELECT '', ln((COUNT(*) FILTER (WHERE y = 'positive') + 1) / (COUNT(*) + 3)), ln((COUNT(*) FILTER (WHERE y = 'negative') + 1) / (COUNT(*) + 3)), ln((COUNT(*) FILTER (WHERE y = 'neutral') + 1) / (COUNT(*) + 3)) FROM d WHERE y IS NOT NULL AND doc_id % 5 <> 0),
 x AS (SELECT doc_id, SUM(p) AS p, SUM(n) AS n, SUM(u) AS u FROM (SELECT doc_id, unnest(list_concat([''], w)) AS word FROM d) JOIN m USING (word) GROUP BY 1),
 e AS (SELECT doc_id, exp(p - greatest(p, n, u)) AS p, exp(n - greatest(p, n, u)) AS n, exp(u - greatest(p, n, u)) AS u FROM x),
 r AS (SELECT doc_id, p / (p + n + u) AS p, n / (p + n + u) AS n, u / (p + n + u) AS u FROM e)
 SELECT doc_id, ROUND(p, 6) AS positive, ROUND(n, 6) AS negative, ROUND(u, 6) AS neutral, ROUND(p - n, 6) AS net_sentiment, CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS label FROM r"""


@query("m12_model_scores", _TRAINED)
def m12_model(t):
    """A model trained on four fifths of the labelled documents scores all of them."""
    docs = t.raw("documents").select("doc_id", "text")
    y = F.when(c("quality") > c("toxic"), "positive").when(c("quality") < c("toxic"), "negative").when(c("quality") == c("toxic"), "neutral")
    known = docs.join(t.raw("labels").select("doc_id", y.alias("y")).where("y is not null"), "doc_id")
    model = cut_lineage(scoring.train_text_model(known.where("doc_id % 5 <> 0"), "text", "y"))
    return rounded(scoring.linear_scores(docs, ["doc_id"], "text", model).select("doc_id", *scoring.SCORE_COLS))
