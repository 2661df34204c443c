"""Feature families on the test tables, each beside a plain SQL statement of the same rule."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidespine.catalog.base import ORACLE, query
from tidespine.functions.scalar import rounded
from tidespine.functions.text import cpc_bucket
from tidespine.plans import events as ev, filings as fl, macro as ma, market as mk, price as pr
from tidespine.plans.attach import attach_daily, spine_of

DAY = "1998-06-15"


def r6(*cols: str) -> str:
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in cols)


@query("f01_price", f"SELECT ticker, date, {r6(*pr.PRICE_COLS)} FROM pf")
def f01(t):
    return rounded(pr.price_features(t.px))


@query("f01_price_one_day", f"SELECT ticker, date, {r6(*pr.PRICE_COLS)} FROM pf WHERE date = DATE '{DAY}'")
def f01_day(t):
    return rounded(pr.price_features(t.px, DAY))


@query("f02_daily_matrix", f"""
SELECT ticker, date, {r6(*pr.PRICE_COLS)},
  ROUND((SELECT COUNT(DISTINCT mmsi) FROM positions WHERE day >= DATE '2024-01-15' - 7 AND day < DATE '2024-01-15'
     AND vessel_type BETWEEN 70 AND 89 AND latitude BETWEEN 21.5 AND 25.5 AND longitude BETWEEN 119 AND 122.5) / 7.0::DOUBLE, 6) AS taiwan_cargo_ratio,
  ROUND(COALESCE((SELECT AVG(net_sentiment) FROM news WHERE day >= DATE '2024-01-15' - 7 AND day < DATE '2024-01-15'), 0.0), 6) AS sentiment_mean,
  '2024-01-15' AS feature_date
FROM (SELECT ticker, date, close_price / NULLIF(LAG(close_price, 1) OVER w, 0) - 1 AS return_1d,
  close_price / NULLIF(LAG(close_price, 5) OVER w, 0) - 1 AS return_5d, close_price / NULLIF(LAG(close_price, 20) OVER w, 0) - 1 AS return_20d,
  close_price / NULLIF(AVG(close_price) OVER r, 0) - 1 AS sma_20_deviation,
  STDDEV_SAMP(close_price) OVER r / NULLIF(AVG(close_price) OVER r, 0) AS volatility_20d,
  volume / NULLIF(AVG(CAST(volume AS DOUBLE)) OVER r, 0) AS volume_ratio
  FROM epx WINDOW w AS (PARTITION BY ticker ORDER BY date), r AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
WHERE date = DATE '2024-01-15'""")
def f02(t):
    from tidespine.functions.text import corridor

    pos = t.positions.withColumn("corridor", corridor("latitude", "longitude"))
    return rounded(pr.daily_matrix(t.epx, pos, t.news, "2024-01-15"))


_DERIVED = """
d0 AS (SELECT *, year(period_end) AS y, quarter(period_end) AS q FROM fq),
d1 AS (SELECT a.*, b.revenue AS prior FROM d0 a LEFT JOIN d0 b ON a.ticker = b.ticker AND a.y = b.y + 1 AND a.q = b.q),
d2 AS (SELECT *, CASE WHEN prior > 0 THEN (revenue - prior) / prior END AS revenue_growth_yoy,
  CASE WHEN COUNT(net_income) OVER r = 4 THEN SUM(net_income) OVER r END AS t_ni, CASE WHEN COUNT(operating_income) OVER r = 4 THEN SUM(operating_income) OVER r END AS t_oi,
  CASE WHEN COUNT(capex) OVER r = 4 THEN SUM(capex) OVER r END AS t_cx, CASE WHEN COUNT(revenue) OVER r = 4 THEN SUM(revenue) OVER r END AS t_rev,
  CASE WHEN COUNT(*) OVER r = 4 THEN SUM(COALESCE(rd_expense, 0.0)) OVER r END AS t_rd
  FROM d1 WINDOW r AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING)),
d3 AS (SELECT *, LAG(t_cx, 4) OVER w AS p_cx, LAG(revenue_growth_yoy) OVER w AS p_yoy FROM d2 WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),
d4 AS (SELECT d3.*, close_price * shares_outstanding AS cap FROM d3 ASOF LEFT JOIN px ON d3.ticker = px.ticker AND d3.period_end >= px.date)"""


@query("f03b_fundamentals_derivation", f"""WITH {_DERIVED}
SELECT ticker, period_end, ROUND(CASE WHEN t_ni > 0 THEN cap / t_ni END, 6) AS pe_ratio_trailing,
 ROUND(CASE WHEN t_rev > 0 THEN cap / t_rev END, 6) AS price_to_sales, ROUND(CASE WHEN equity > 0 THEN cap / equity END, 6) AS price_to_book,
 ROUND(revenue_growth_yoy, 6) AS revenue_growth_yoy, ROUND(gross_profit / NULLIF(revenue, 0), 6) AS gross_margin,
 ROUND(operating_income / NULLIF(revenue, 0), 6) AS operating_margin, ROUND(capex / NULLIF(revenue, 0), 6) AS capex_to_revenue,
 ROUND(CASE WHEN equity > 0 THEN long_term_debt / equity END, 6) AS debt_to_equity,
 ROUND(CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities END, 6) AS current_ratio,
 ROUND(COALESCE(t_ni / NULLIF(t_rev, 0), 0.0), 6) AS net_income_margin, ROUND(COALESCE((t_oi - t_cx) / NULLIF(t_rev, 0), 0.0), 6) AS free_cash_flow_margin,
 ROUND(CASE WHEN p_cx > 0 THEN t_cx / p_cx - 1 END, 6) AS capex_growth_yoy, ROUND(COALESCE(revenue_growth_yoy - p_yoy, 0.0), 6) AS revenue_growth_accel,
 ROUND(COALESCE(t_rd / NULLIF(t_rev, 0), 0.0), 6) AS research_to_revenue FROM d4""")
def f03b(t):
    wide = fl.valuation(fl.derive_ratios(t.fq), t.px)
    return rounded(wide.select("ticker", "period_end", *fl.FUNDAMENTAL_COLS))


_RATIOS = _DERIVED + """,
fr AS (SELECT ticker, period_end, CASE WHEN t_ni > 0 THEN cap / t_ni END AS pe_ratio_trailing, CASE WHEN t_rev > 0 THEN cap / t_rev END AS price_to_sales,
 CASE WHEN equity > 0 THEN cap / equity END AS price_to_book, revenue_growth_yoy, gross_profit / NULLIF(revenue, 0) AS gross_margin,
 operating_income / NULLIF(revenue, 0) AS operating_margin, capex / NULLIF(revenue, 0) AS capex_to_revenue, CASE WHEN equity > 0 THEN long_term_debt / equity END AS debt_to_equity,
 CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities END AS current_ratio, COALESCE(t_ni / NULLIF(t_rev, 0), 0.0) AS net_income_margin,
 COALESCE((t_oi - t_cx) / NULLIF(t_rev, 0), 0.0) AS free_cash_flow_margin, CASE WHEN p_cx > 0 THEN t_cx / p_cx - 1 END AS capex_growth_yoy,
 COALESCE(revenue_growth_yoy - p_yoy, 0.0) AS revenue_growth_accel, COALESCE(t_rd / NULLIF(t_rev, 0), 0.0) AS research_to_revenue FROM d4)"""


@query("f03_fundamentals", f"""WITH {_RATIOS}
SELECT px.ticker, px.date, {r6(*fl.FUNDAMENTAL_COLS)} FROM (SELECT * FROM px) px ASOF LEFT JOIN fr ON px.ticker = fr.ticker AND px.date >= fr.period_end""")
def f03(t):
    return rounded(fl.attach_fundamentals(spine_of(t.px), fl.valuation(fl.derive_ratios(t.fq), t.px)))


@query("f04_insider", """
WITH s AS (SELECT DISTINCT ticker, date FROM px),
a AS (SELECT s.ticker, s.date, NULLIF(COUNT(DISTINCT CASE WHEN transaction_code = 'P' THEN insider_name END), 0) AS insider_cluster_buy_90d,
  CAST(SUM(CASE WHEN transaction_date >= s.date - 30 THEN CASE transaction_code WHEN 'P' THEN value WHEN 'S' THEN -value ELSE 0 END END) AS DOUBLE) / 1e6 AS net,
  COUNT(CASE WHEN transaction_date >= s.date - 30 THEN 1 END) AS n30, COUNT(CASE WHEN transaction_code = 'P' THEN 1 END) / NULLIF(COUNT(transaction_code), 0) AS share
  FROM s LEFT JOIN tr ON tr.ticker = s.ticker AND transaction_date BETWEEN s.date - 90 AND s.date GROUP BY 1, 2),
c AS (SELECT s.ticker, s.date, CAST(SUM(CASE transaction_type WHEN 'purchase' THEN amount_mid WHEN 'sale' THEN -amount_mid ELSE 0 END) AS DOUBLE) / 1e6 AS net,
  NULLIF(COUNT(transaction_type), 0) AS n FROM s LEFT JOIN cg ON cg.ticker = s.ticker AND trade_date BETWEEN s.date - 90 AND s.date GROUP BY 1, 2)
SELECT a.ticker, a.date, insider_cluster_buy_90d, ROUND(CASE WHEN n30 > 0 THEN a.net END, 9) AS insider_net_value_30d,
  ROUND(share, 9) AS insider_buy_sell_ratio_90d, ROUND(CASE WHEN n > 0 THEN c.net END, 9) AS congress_net_buy_90d, n AS congress_trade_count_90d
FROM a JOIN c USING (ticker, date)""")
def f04(t):
    return rounded(ev.insider_features(t.px, t.tr, t.cg), 9)


_SENT = """
s AS (SELECT ticker, date FROM evspine),
a7 AS (SELECT s.ticker, s.date, AVG(net_sentiment) AS m7, STDDEV_SAMP(net_sentiment) AS sd, COUNT(net_sentiment) AS n
  FROM s LEFT JOIN tagged a ON a.ticker = s.ticker AND a.day BETWEEN s.date - 7 AND s.date GROUP BY 1, 2),
a14 AS (SELECT s.ticker, s.date, AVG(net_sentiment) AS p FROM s LEFT JOIN tagged a ON a.ticker = s.ticker AND a.day BETWEEN s.date - 14 AND s.date - 8 GROUP BY 1, 2),
md AS (SELECT day, AVG(net_sentiment) AS mm FROM news GROUP BY 1),
mk AS (SELECT d.date, AVG(mm) AS mk FROM (SELECT DISTINCT date FROM s) d LEFT JOIN md ON md.day BETWEEN d.date - 7 AND d.date GROUP BY 1),
sf AS (SELECT a7.ticker, a7.date, m7 AS sentiment_mean_7d, sd AS sentiment_std_7d, n AS article_count_7d, m7 - p AS sentiment_momentum_14d,
  m7 - mk AS ticker_vs_market_7d FROM a7 JOIN a14 USING (ticker, date) JOIN mk USING (date))"""


@query("f05_sentiment", f"""WITH {_SENT}
SELECT ticker, date, article_count_7d, {r6('sentiment_mean_7d', 'sentiment_std_7d', 'sentiment_momentum_14d', 'ticker_vs_market_7d')} FROM sf""")
def f05(t):
    return rounded(ev.sentiment_features(t.evspine, t.news))


@query("f05_sentiment_attach", f"""WITH {_SENT},
q AS (SELECT ticker, date + 20 AS date FROM evspine UNION SELECT ticker, date + 45 FROM evspine)
SELECT q.ticker, q.date, CASE WHEN q.date - sf.date <= 30 THEN ROUND(sentiment_mean_7d, 6) END AS sentiment_mean_7d,
 CASE WHEN q.date - sf.date <= 30 THEN ROUND(sentiment_std_7d, 6) END AS sentiment_std_7d,
 COALESCE(CASE WHEN q.date - sf.date <= 30 THEN article_count_7d END, 0) AS article_count_7d,
 CASE WHEN q.date - sf.date <= 30 THEN ROUND(sentiment_momentum_14d, 6) END AS sentiment_momentum_14d,
 CASE WHEN q.date - sf.date <= 30 THEN ROUND(ticker_vs_market_7d, 6) END AS ticker_vs_market_7d
FROM q ASOF LEFT JOIN sf ON q.ticker = sf.ticker AND q.date >= sf.date""")
def f05_attach(t):
    later = t.evspine.select("ticker", F.explode(F.array(F.date_add("date", 20), F.date_add("date", 45))).alias("date")).distinct()
    return rounded(ev.attach_sentiment(later, ev.sentiment_features(t.evspine, t.news)))


@query("f06_news_daily", """
SELECT day AS date, ROUND(m, 6) AS mean_sentiment, ROUND(sd, 6) AS sentiment_dispersion, n AS article_volume, CAST(pos AS BIGINT) AS positive_count,
 CAST(neg AS BIGINT) AS negative_count, ROUND(m - LAG(m, 7) OVER (ORDER BY day), 6) AS sentiment_momentum_7d,
 ROUND(m - LAG(m, 30) OVER (ORDER BY day), 6) AS sentiment_momentum_30d
FROM (SELECT day, AVG(net_sentiment) AS m, STDDEV_SAMP(net_sentiment) AS sd, COUNT(*) AS n, SUM(CASE WHEN label = 'positive' THEN 1 ELSE 0 END) AS pos,
 SUM(CASE WHEN label = 'negative' THEN 1 ELSE 0 END) AS neg FROM news GROUP BY 1)""")
def f06(t):
    return rounded(ev.daily_news(t.news))


@query("f07_short_interest", """
WITH s AS (SELECT DISTINCT ticker, date FROM px),
w AS (SELECT s.ticker, s.date, AVG(CASE WHEN si.date >= s.date - 10 THEN short_vol_ratio END) AS a, AVG(short_vol_ratio) AS b,
 AVG(CASE WHEN si.date BETWEEN s.date - 20 AND s.date - 11 THEN short_vol_ratio END) AS p
 FROM s LEFT JOIN si ON si.ticker = s.ticker AND si.date BETWEEN s.date - 30 AND s.date GROUP BY 1, 2)
SELECT ticker, date, ROUND(a, 12) AS short_vol_ratio_10d, ROUND(b, 12) AS short_vol_ratio_30d, ROUND(a - p, 12) AS short_ratio_momentum FROM w""")
def f07(t):
    return rounded(ev.short_interest_features(t.px, t.si), 12)


_STATES = """
e1 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end) AS rn FROM er),
e2 AS (SELECT *, rn - COALESCE(MAX(CASE WHEN eps_surprise IS NULL OR eps_surprise <= 0 THEN rn END) OVER (PARTITION BY ticker ORDER BY rn), 0) AS streak,
  (SELECT AVG(p) FROM (SELECT eps_surprise_pct AS p FROM e1 b WHERE b.ticker = e1.ticker AND b.rn <= e1.rn AND eps_surprise_pct IS NOT NULL ORDER BY b.rn DESC LIMIT 4)) AS m4 FROM e1)"""


@query("f08_earnings", f"""WITH {_STATES}
SELECT px.ticker, px.date, ROUND(eps_surprise_pct, 6) AS eps_surprise_last, ROUND(m4, 6) AS eps_surprise_mean_4q, CAST(COALESCE(streak, 0) AS INTEGER) AS eps_beat_streak
FROM (SELECT * FROM px) px ASOF LEFT JOIN e2 ON px.ticker = e2.ticker AND px.date >= e2.quarter_end""")
def f08(t):
    return rounded(fl.attach_earnings(spine_of(t.px), t.er))


@query("f09_graph", """
WITH s AS (SELECT DISTINCT ticker, date FROM px),
e0 AS (SELECT least(party_a, party_b) AS a, greatest(party_a, party_b) AS b, SUM(confidence * power(0.5, (DATE '2001-12-31' - date) / 365.25)) AS w FROM deals GROUP BY 1, 2),
e AS (SELECT a AS f, b AS t, w FROM e0 UNION ALL SELECT b, a, w FROM e0),
asked AS (SELECT s.ticker, s.date, t AS partner, w FROM s JOIN e ON e.f = s.ticker),
pd AS (SELECT DISTINCT partner, date FROM asked),
mv AS (SELECT pd.partner, pd.date, CASE WHEN COUNT(*) >= 2 THEN arg_max(close_price, px.date) / NULLIF(arg_min(close_price, px.date), 0) - 1 END AS r
  FROM pd JOIN px ON px.ticker = pd.partner AND px.date BETWEEN pd.date - 30 AND pd.date GROUP BY 1, 2),
mom AS (SELECT ticker, date, SUM(w * r) / NULLIF(SUM(w), 0) AS m FROM asked JOIN mv USING (partner, date) WHERE r IS NOT NULL GROUP BY 1, 2),
dc AS (SELECT DISTINCT e.f AS ticker, d.party_a, d.party_b, d.date, d.n FROM (SELECT party_a, party_b, date, COUNT(*) AS n FROM deals GROUP BY 1, 2, 3) d
  JOIN e ON e.t IN (d.party_a, d.party_b) WHERE e.f NOT IN (d.party_a, d.party_b)),
dcd AS (SELECT ticker, date AS dd, SUM(n) AS n FROM dc GROUP BY 1, 2),
cnt AS (SELECT s.ticker, s.date, SUM(n) AS n FROM s JOIN dcd ON dcd.ticker = s.ticker AND dd BETWEEN s.date - 90 AND s.date GROUP BY 1, 2),
ppa AS (SELECT date AS dd, party_a AS ticker, deal_mw, buyer_type FROM deals WHERE deal_type = 'power_purchase_agreement'
  UNION ALL SELECT date, party_b, deal_mw, buyer_type FROM deals WHERE deal_type = 'power_purchase_agreement' AND party_a <> party_b),
pw AS (SELECT s.ticker, s.date, SUM(deal_mw) AS mw, COUNT(*) FILTER (buyer_type = 'hyperscaler') AS n FROM s JOIN ppa ON ppa.ticker = s.ticker AND dd BETWEEN s.date - 90 AND s.date GROUP BY 1, 2)
SELECT s.ticker, s.date, ROUND(m, 6) AS graph_partner_momentum_30d, CAST(COALESCE(cnt.n, 0) AS DOUBLE) AS graph_deal_count_90d,
 CASE WHEN s.ticker IN ('NATION_3', 'NATION_7') THEN 1.0::DOUBLE WHEN EXISTS (SELECT 1 FROM e WHERE f = s.ticker AND t IN ('NATION_3', 'NATION_7')) THEN 0.5::DOUBLE END AS graph_hops_to_hyperscaler,
 CAST(COALESCE(mw, 0) AS DOUBLE) AS energy_deal_mw_90d, CAST(COALESCE(pw.n, 0) AS DOUBLE) AS hyperscaler_ppa_count_90d
FROM s LEFT JOIN mom USING (ticker, date) LEFT JOIN cnt USING (ticker, date) LEFT JOIN pw USING (ticker, date)""")
def f09(t):
    from tidespine.operators.graph import decayed_edges

    px, deals = t.stored("px"), t.stored("deals")
    return rounded(mk.graph_features(px, px, decayed_edges(deals, "2001-12-31"), deals, ["NATION_3", "NATION_7"]))


_OWN = """
tot AS (SELECT ticker, quarter, period_end, SUM(shares_held) AS total, COUNT(DISTINCT cik) AS holders FROM hold GROUP BY 1, 2, 3),
top AS (SELECT ticker, quarter, SUM(shares_held) AS top10 FROM (SELECT ticker, quarter, shares_held, row_number() OVER (PARTITION BY ticker, quarter ORDER BY shares_held DESC) AS r FROM hold) WHERE r <= 10 GROUP BY 1, 2),
j AS (SELECT tot.*, top10, shares_outstanding AS so, total / NULLIF(shares_outstanding, 0) * 100.0 AS pct FROM tot JOIN top USING (ticker, quarter) LEFT JOIN shares USING (ticker)),
own AS (SELECT ticker, quarter, period_end, ROUND(pct::DOUBLE, 6) AS inst_ownership_pct, ROUND(((total - LAG(total) OVER w) / so)::DOUBLE, 6) AS inst_net_shares_qoq,
 CAST(holders AS INTEGER) AS inst_holder_count, ROUND((top10 / total)::DOUBLE, 6) AS inst_concentration_top10, ROUND((pct - LAG(pct, 2) OVER w)::DOUBLE, 6) AS inst_momentum_2q
 FROM j WINDOW w AS (PARTITION BY ticker ORDER BY period_end))"""


@query("f10_ownership", f"WITH {_OWN} SELECT * FROM own")
def f10(t):
    return rounded(fl.ownership_features(t.hold, t.shares))


@query("f10_ownership_attach", f"""WITH {_OWN}
SELECT b.ticker, b.date, inst_ownership_pct, inst_net_shares_qoq, inst_holder_count, inst_concentration_top10, inst_momentum_2q
FROM (SELECT ticker, date FROM bpx) b ASOF LEFT JOIN own ON b.ticker = own.ticker AND b.date >= own.period_end""")
def f10_attach(t):
    return rounded(fl.attach_ownership(spine_of(t.bpx), fl.ownership_features(t.hold, t.shares)))


_REGIONS = ", ".join(f"('{r}', '{c}')" for r, cs in ma.REGION_COUNTRIES.items() for c in cs)


@query("f11_energy_geo", f"""
WITH d AS (SELECT DISTINCT date FROM px), z AS (SELECT date AS zd, queue_backlog_gw AS g FROM zones WHERE zone = 'ALL_VIRGINIA'),
base AS (SELECT date, SUM(cg) AS base FROM (SELECT d.date, fuel_type, arg_max(capacity_gw, c.date) AS cg FROM d JOIN capacity c ON c.date <= d.date GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT d.date, arg_max(g, zd) AS g, COUNT(*) FILTER (zd >= d.date - 1095) AS n, MIN(g) FILTER (zd >= d.date - 1095) AS lo, MAX(g) FILTER (zd >= d.date - 1095) AS hi
  FROM d JOIN z ON zd <= d.date GROUP BY 1),
moat AS (SELECT date, CASE WHEN g / NULLIF(base, 0) IS NULL THEN 0.0 WHEN n < 2 THEN least(g / base, 1.0) WHEN hi / base = lo / base THEN 0.5
  ELSE greatest(0.0, least(1.0, (g / base - lo / base) / (hi / base - lo / base))) END AS moat FROM d LEFT JOIN h USING (date) LEFT JOIN base USING (date)),
rc(region, country) AS (VALUES {_REGIONS}), ys AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM px),
lvl AS (SELECT y, off, region, AVG(ren) AS ren, AVG(co2) AS co2 FROM (SELECT ys.y, o.off, rc.region, rc.country, arg_max(renewables_pct, e.year) AS ren, arg_max(carbon_intensity_gco2_per_kwh, e.year) AS co2
  FROM ys, (VALUES (0), (1)) o(off), rc, energy e WHERE e.country = rc.country AND e.year <= ys.y - o.off GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
tw AS (SELECT c.y, c.region, 0.6 * greatest(0.0, c.ren - COALESCE(p.ren, c.ren)) * 10 + 0.4 * (1.0 - greatest(0.0, least(1.0, c.co2 / 500.0))) AS tail
  FROM (SELECT * FROM lvl WHERE off = 0) c LEFT JOIN (SELECT * FROM lvl WHERE off = 1) p ON p.y = c.y AND p.region = c.region),
ex AS (SELECT ticker, region, weight FROM exposure UNION ALL SELECT DISTINCT ticker, 'north_america', 1.0 FROM px WHERE ticker NOT IN (SELECT ticker FROM exposure)),
sc AS (SELECT ticker, y, greatest(0.0, least(1.0, SUM(weight * tail) / SUM(weight))) AS s FROM ex JOIN tw USING (region) GROUP BY 1, 2)
SELECT px.ticker, px.date, ROUND(CASE WHEN px.ticker IN ('NATION_1', 'NATION_2', 'NATION_12') THEN CAST(moat AS DOUBLE) ELSE 0.0 END, 6) AS us_power_moat_score,
  ROUND(CAST(COALESCE(s, 0.0) AS DOUBLE), 6) AS geo_weighted_tailwind_score
FROM px LEFT JOIN moat USING (date) LEFT JOIN sc ON sc.ticker = px.ticker AND sc.y = year(px.date)""")
def f11(t):
    return rounded(ma.attach_energy(spine_of(t.stored("px")), t.zones, t.capacity, t.energy, t.exposure,
                                    ["NATION_1", "NATION_2", "NATION_12"]))


_CAL = """
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM px)),
pi AS (SELECT ticker, date, idx, close_price FROM px JOIN cal USING (date)),
r20 AS (SELECT a.ticker, a.date, a.close_price / NULLIF(b.close_price, 0) - 1 AS r FROM pi a JOIN pi b ON a.ticker = b.ticker AND b.idx = a.idx - 20)"""


@query("f12_layer_momentum", f"""WITH {_CAL}
SELECT px.ticker, px.date, ROUND((SELECT CASE WHEN COUNT(*) >= 2 THEN AVG(r) END FROM r20 JOIN nat n USING (ticker) WHERE r20.date = px.date AND n.layer = nat.layer AND r20.ticker <> px.ticker), 6) AS own_layer_momentum_20d,
 ROUND((SELECT CASE WHEN COUNT(*) >= 5 THEN AVG(r) END FROM r20 JOIN nat n USING (ticker) WHERE r20.date = px.date AND n.layer <> nat.layer), 6) AS ecosystem_momentum_20d
FROM px JOIN nat USING (ticker)""")
def f12_momentum(t):
    from tidespine.operators.calendar import calendar_change, with_calendar

    px = t.stored("px")
    ret = calendar_change(with_calendar(px), "close_price", 20, "ret_20d")
    return rounded(mk.layer_momentum(spine_of(px), ret, t.layers))


_CORR = f"""{_CAL},
span AS (SELECT ticker, MIN(idx) AS a FROM pi GROUP BY 1),
grid AS (SELECT s.ticker, c.idx FROM span s JOIN cal c ON c.idx >= s.a),
ff AS (SELECT g.ticker, g.idx, close_price FROM grid g ASOF JOIN pi ON g.ticker = pi.ticker AND g.idx >= pi.idx),
ret AS (SELECT ticker, idx, close_price / NULLIF(LAG(close_price) OVER (PARTITION BY ticker ORDER BY idx), 0) - 1 AS r FROM ff),
pr AS (SELECT ticker, peer FROM peers),
xy AS (SELECT pr.ticker, pr.peer, x.idx, x.r AS x, y.r AS y FROM pr JOIN ret x ON x.ticker = pr.ticker JOIN ret y ON y.ticker = pr.peer AND y.idx = x.idx WHERE x.r IS NOT NULL AND y.r IS NOT NULL),
cw AS (SELECT ticker, peer, idx, COUNT(*) OVER w AS n, covar_pop(x, y) OVER w AS cv, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy FROM xy
  WINDOW w AS (PARTITION BY ticker, peer ORDER BY idx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
cm AS (SELECT ticker, idx, CASE WHEN COUNT(*) >= 5 THEN AVG(cv / sqrt(vx * vy)) END AS c FROM cw WHERE n >= 30 AND vx > 1e-18 AND vy > 1e-18 GROUP BY 1, 2)"""


@query("f12_peer_correlation", f"""WITH {_CORR}
SELECT pi.ticker, pi.date, ROUND(c, 5) AS supply_chain_correlation_60d FROM pi LEFT JOIN cm USING (ticker, idx)""")
def f12_corr(t):
    px = t.stored("px")
    return rounded(mk.peer_correlation(spine_of(px), px, t.peers), 5)


@query("f12_peer_surprise", """
SELECT px.ticker, px.date, ROUND(AVG(e.eps_surprise_pct), 6) AS peer_eps_surprise_mean FROM px JOIN nat a USING (ticker)
LEFT JOIN (SELECT er.*, layer FROM er JOIN nat USING (ticker)) e ON e.layer = a.layer AND e.ticker <> px.ticker AND e.quarter_end BETWEEN px.date - 90 AND px.date GROUP BY 1, 2""")
def f12_surprise(t):
    return rounded(mk.peer_surprise(spine_of(t.px), t.er, t.layers))


_BASE = """bp AS (SELECT px.ticker, px.date, CASE WHEN COALESCE(currency, 'USD') = 'USD' THEN close_price ELSE close_price * rate END AS close_price
  FROM px LEFT JOIN currencies c USING (ticker) LEFT JOIN rates r ON r.pair = c.pair AND r.date = px.date),
bpi AS (SELECT ticker, date, idx, bp.close_price FROM bp JOIN cal USING (date) WHERE bp.close_price IS NOT NULL)"""
_MOMENTUM = """SELECT CASE WHEN COUNT(*) >= {least} THEN AVG(r) END FROM r20 JOIN nat n USING (ticker) WHERE r20.date = pi.date AND n.layer {op} a.layer AND r20.ticker <> pi.ticker"""
_SUPPLY = f"""{_CORR.replace(_CAL, _CAL + "," + chr(10) + _BASE).replace("FROM pi GROUP BY 1)", "FROM bpi GROUP BY 1)").replace("ASOF JOIN pi ON g.ticker = pi.ticker AND g.idx >= pi.idx", "ASOF JOIN bpi ON g.ticker = bpi.ticker AND g.idx >= bpi.idx")},
sup AS (SELECT px.ticker, px.date, ROUND(AVG(e.eps_surprise_pct), 5) AS peer_eps_surprise_mean FROM px JOIN nat a USING (ticker)
  LEFT JOIN (SELECT er.*, layer FROM er JOIN nat USING (ticker)) e ON e.layer = a.layer AND e.ticker <> px.ticker AND e.quarter_end BETWEEN px.date - 90 AND px.date GROUP BY 1, 2)"""


@query("f12_supply_chain", f"""WITH {_SUPPLY}
SELECT pi.ticker, pi.date, ROUND(({_MOMENTUM.format(least=2, op='=')}), 5) AS own_layer_momentum_20d, ROUND(({_MOMENTUM.format(least=5, op='<>')}), 5) AS ecosystem_momentum_20d,
 ROUND(c, 5) AS supply_chain_correlation_60d, peer_eps_surprise_mean FROM pi JOIN nat a USING (ticker) LEFT JOIN cm USING (ticker, idx) LEFT JOIN sup ON sup.ticker = pi.ticker AND sup.date = pi.date""")
def f12(t):
    px = t.stored("px")
    base = mk.base_currency_prices(px, t.currencies, t.rates)
    return rounded(mk.supply_chain_features(spine_of(px), px, t.layers, t.peers, t.stored("er"), base), 5)


@query("f13_fx", """
WITH f AS (SELECT px.ticker, px.date, close_price * rate AS u FROM px JOIN currencies c USING (ticker) LEFT JOIN rates r ON r.pair = c.pair AND r.date = px.date WHERE currency <> 'USD'),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM f)), fi AS (SELECT f.*, idx FROM f JOIN cal USING (date)),
m AS (SELECT a.ticker, a.date, a.u / NULLIF(b.u, 0) - 1 AS r FROM fi a JOIN fi b ON a.ticker = b.ticker AND b.idx = a.idx - 20)
SELECT px.ticker, px.date, ROUND(r, 6) AS fx_adjusted_return_20d FROM px LEFT JOIN m ON m.ticker = px.ticker AND m.date = px.date""")
def f13(t):
    px = t.stored("px")
    return rounded(mk.fx_features(spine_of(px), px, t.currencies, t.rates))


_CYBER = """
dy AS (SELECT date, COALESCE(SUM(value) FILTER (metric = 'cve_critical'), 0) AS cc, COALESCE(SUM(value) FILTER (metric = 'cve_high'), 0) AS ch,
 COALESCE(SUM(value) FILTER (metric = 'cisa_kev'), 0) AS ck, COALESCE(SUM(value) FILTER (metric = 'otx_pulse'), 0) AS ox FROM threats GROUP BY 1),
w1 AS (SELECT date, SUM(cc) OVER w AS cve_critical_7d, SUM(ch) OVER w AS cve_high_7d, SUM(ck) OVER w AS cisa_kev_7d, SUM(ox) OVER w AS otx_pulse_7d,
 SUM(cc) OVER m AS cve_critical_30d, SUM(ck) OVER m AS cisa_kev_30d FROM dy
 WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), m AS (ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, cve_critical_7d * 3 + cve_high_7d + cisa_kev_7d * 2 AS k FROM w1),
cy AS (SELECT *, least(1.0, greatest(0.0, k / greatest(1.0, MAX(k) OVER (ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)))) AS cyber_threat_index_7d FROM w2)"""


@query("f14_cyber", f"WITH {_CYBER} SELECT date, {r6(*ma.CYBER_COLS)} FROM cy")
def f14(t):
    return rounded(ma.cyber_features(t.threats))


@query("f14_cyber_attach", f"""WITH {_CYBER}, q AS (SELECT ticker, date FROM evspine UNION SELECT ticker, date + 3 FROM evspine)
SELECT ticker, date, {", ".join(f"ROUND(COALESCE({c}, 0.0), 6) AS {c}" for c in ma.CYBER_COLS)} FROM q LEFT JOIN cy USING (date)""")
def f14_attach(t):
    spine = t.evspine.unionByName(t.evspine.select("ticker", F.date_add("date", 3).alias("date"))).distinct()
    return rounded(attach_daily(spine, ma.cyber_features(t.threats), ma.CYBER_COLS, zero=True))


_OPT = """
ex AS (SELECT DISTINCT ticker, date, expiry, expiry - date AS dte FROM options),
ne AS (SELECT ticker, date, arg_min(expiry, abs(dte - 30) * 10000 + dte) AS expiry FROM ex WHERE dte > 0 AND dte <= 45 GROUP BY 1, 2),
me AS (SELECT ticker, date, arg_min(expiry, abs(dte - 90) * 10000 + dte) AS expiry FROM ex WHERE dte > 0 AND dte <= 180 GROUP BY 1, 2),
nr AS (SELECT * FROM options SEMI JOIN ne USING (ticker, date, expiry)), mr AS (SELECT * FROM options SEMI JOIN me USING (ticker, date, expiry)),
sp AS (SELECT ticker, date, MEDIAN(strike) AS spot FROM nr GROUP BY 1, 2),
n1 AS (SELECT ticker, date, any_value(spot) AS spot,
 COALESCE(SUM(oi) FILTER (option_type = 'put') / NULLIF(SUM(oi) FILTER (option_type = 'call'), 0), 0.0) AS pco,
 COALESCE(SUM(volume) FILTER (option_type = 'put') / NULLIF(SUM(volume) FILTER (option_type = 'call'), 0), 0.0) AS pcv,
 (MIN({'d': abs(strike - spot), 'k': strike})).k AS atm,
 (MIN(CASE WHEN option_type = 'put' AND strike BETWEEN spot * 0.88 AND spot * 0.97 THEN {'d': abs(strike - spot * 0.925), 'k': strike} END)).k AS ps,
 (MIN(CASE WHEN option_type = 'call' AND strike BETWEEN spot * 1.03 AND spot * 1.12 THEN {'d': abs(strike - spot * 1.075), 'k': strike} END)).k AS cs
 FROM nr JOIN sp USING (ticker, date) GROUP BY 1, 2),
n2 AS (SELECT ticker, date, MIN(iv) FILTER (option_type = 'put' AND strike = ps AND iv > 0) AS piv, MIN(iv) FILTER (option_type = 'call' AND strike = cs AND iv > 0) AS civ,
 COALESCE(CASE WHEN COUNT(*) FILTER (option_type = 'call' AND strike = atm) > 0 THEN MIN(iv) FILTER (option_type = 'call' AND strike = atm AND iv > 0) ELSE MIN(iv) FILTER (strike = atm AND iv > 0) END, 0.0) AS iv
 FROM nr JOIN n1 USING (ticker, date) GROUP BY 1, 2),
m0 AS (SELECT ticker, date, (MIN({'d': abs(strike - spot), 'k': strike})).k AS atm FROM mr JOIN sp USING (ticker, date) GROUP BY 1, 2),
m1 AS (SELECT ticker, date, COALESCE(CASE WHEN COUNT(*) FILTER (option_type = 'call' AND strike = atm) > 0 THEN MIN(iv) FILTER (option_type = 'call' AND strike = atm AND iv > 0) ELSE MIN(iv) FILTER (strike = atm AND iv > 0) END, 0.0) AS ivm
 FROM mr JOIN m0 USING (ticker, date) GROUP BY 1, 2),
lr AS (SELECT ticker, date, CASE WHEN LAG(close_price) OVER w > 0 THEN ln(close_price / LAG(close_price) OVER w) END AS lr FROM bpx WINDOW w AS (PARTITION BY ticker ORDER BY date)),
hv AS (SELECT ticker, date AS pd, CASE WHEN COUNT(lr) OVER w >= 2 THEN STDDEV_SAMP(lr) OVER w * sqrt(252.0) END AS hv FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)),
od AS (SELECT DISTINCT ticker, date FROM options),
a0 AS (SELECT od.ticker, od.date, n1.spot, pco, pcv, ps, cs, piv, civ, iv, ivm FROM od LEFT JOIN n1 USING (ticker, date) LEFT JOIN n2 USING (ticker, date) LEFT JOIN m1 USING (ticker, date)),
a1 AS (SELECT a0.*, hv FROM a0 ASOF LEFT JOIN hv ON a0.ticker = hv.ticker AND a0.date >= hv.pd),
a2 AS (SELECT *, COUNT(CASE WHEN iv > 0 THEN 1 END) OVER (PARTITION BY ticker ORDER BY date) AS seen FROM a1),
a3 AS (SELECT *, MIN(CASE WHEN iv > 0 THEN iv END) OVER w AS lo, MAX(CASE WHEN iv > 0 THEN iv END) OVER w AS hi FROM a2 WINDOW w AS (PARTITION BY ticker ORDER BY seen RANGE BETWEEN 251 PRECEDING AND CURRENT ROW))"""


@query("f15_options", f"""WITH {_OPT}
SELECT ticker, date, ROUND(CASE WHEN spot IS NULL THEN 0.0 WHEN seen < 30 OR hi <= lo THEN 50.0 ELSE greatest(0.0, least(100.0, (iv - lo) / NULLIF(hi - lo, 0) * 100.0)) END::DOUBLE, 6) AS iv_rank_30d,
 ROUND(COALESCE(CASE WHEN spot IS NOT NULL THEN iv - hv END, 0.0)::DOUBLE, 6) AS iv_hv_spread, ROUND(COALESCE(pco, 0.0)::DOUBLE, 6) AS put_call_oi_ratio,
 ROUND(COALESCE(pcv, 0.0)::DOUBLE, 6) AS put_call_vol_ratio,
 ROUND(COALESCE(CASE WHEN ps IS NOT NULL AND cs IS NOT NULL THEN COALESCE(piv, 0.0) - COALESCE(civ, 0.0) END, 0.0)::DOUBLE, 6) AS skew_otm,
 ROUND(COALESCE(CASE WHEN spot IS NOT NULL THEN iv - ivm END, 0.0)::DOUBLE, 6) AS iv_term_slope FROM a3""")
def f15(t):
    return rounded(mk.option_features(t.options, t.bpx))


@query("f16_gov_ticker", """
WITH s AS (SELECT DISTINCT ticker, date FROM px), a AS (SELECT n.ticker, w.date AS wd, SUM(contract_value_usd::DECIMAL(18,2))::DOUBLE AS v, COUNT(*) AS n FROM awards w JOIN award_names n USING (awardee_name) GROUP BY 1, 2),
x AS (SELECT s.ticker, s.date, COALESCE(SUM(v), 0.0) AS v90, COALESCE(SUM(n), 0) AS n90, COALESCE(SUM(v) FILTER (wd >= s.date - 30), 0.0) AS v30
 FROM s LEFT JOIN a ON a.ticker = s.ticker AND wd BETWEEN s.date - 90 AND s.date GROUP BY 1, 2)
SELECT ticker, date, ROUND(v90, 2) AS gov_contract_value_90d, CAST(n90 AS DOUBLE) AS gov_contract_count_90d, ROUND(2.0 * v30 - v90, 2) AS gov_contract_momentum FROM x""")
def f16(t):
    return rounded(ma.gov_ticker_features(t.px, t.awards, t.award_names), 2)


def spelled(t, rows, column):
    """The rows with the entity's name in one of four spellings in place of the supplier's, by the row's supplier."""
    named = rows.join(t.award_names.withColumnRenamed("awardee_name", column), column)
    forms = F.array(F.initcap("ticker"), F.concat("ticker", F.lit(" INC")), F.concat(F.lower("ticker"), F.lit(" llc")), F.concat(F.lit("  "), "ticker", F.lit(" Corp")))
    return named.withColumn(column, F.get(forms, F.pmod(F.xxhash64(column), F.lit(4)).cast("int"))).drop("ticker")


@query("f16_gov_ticker_matched")
def f16_matched(t):
    awards = spelled(t, t.awards, "awardee_name")
    names = ma.matched_names(awards, "awardee_name", t.layers.select("ticker", F.col("ticker").alias("search_name")))
    return rounded(ma.gov_ticker_features(t.px, awards, names), 2)


ORACLE["f16_gov_ticker_matched"] = ORACLE["f16_gov_ticker"]  # any spelling is to find its entity


@query("f16_gov_market", """
WITH d AS (SELECT DISTINCT date FROM px),
sp AS (SELECT d.date, COALESCE(SUM(contract_value_usd::DECIMAL(18,2))::DOUBLE, 0.0) AS s FROM d LEFT JOIN (SELECT date AS wd, contract_value_usd FROM awards WHERE naics_code IN ('334413', '518210', '541511', '541512', '541519')) a ON wd BETWEEN d.date - 30 AND d.date GROUP BY 1),
q1 AS (SELECT queue_date, mw, state FROM (SELECT *, row_number() OVER (PARTITION BY project_name, queue_date ORDER BY snapshot_date DESC, mw DESC, state DESC) AS rn FROM queue) WHERE rn = 1 AND state IN ('AZ', 'GA', 'NV', 'OH', 'OR', 'TX', 'VA', 'WA')),
qq AS (SELECT d.date, COALESCE(SUM(mw) FILTER (queue_date >= d.date - 30), 0.0) AS m30, COALESCE(SUM(mw), 0.0) AS m365 FROM d LEFT JOIN q1 ON queue_date BETWEEN d.date - 365 AND d.date GROUP BY 1)
SELECT date, ROUND(s, 2) AS gov_ai_spend_30d, ROUND(m30, 6) AS ferc_queue_mw_30d, ROUND(m30 / greatest(m365 / 12.0, 1.0), 6) AS ferc_grid_constraint_score FROM sp JOIN qq USING (date)""")
def f16_market(t):
    out = rounded(ma.gov_market_features(t.px, t.awards, t.queue))
    return out.withColumn("gov_ai_spend_30d", F.round("gov_ai_spend_30d", 2))


_PAT = """
a1 AS (SELECT app_id, assignee_name, cpc_group, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date DESC, assignee_name DESC, cpc_group DESC, filing_date DESC) AS rn FROM apps) WHERE rn = 1),
g1 AS (SELECT patent_id, assignee_name, grant_date, forward_citation_count AS fc FROM (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY date DESC, assignee_name DESC, grant_date DESC, forward_citation_count DESC) AS rn FROM grants) WHERE rn = 1),
am AS (SELECT n.ticker, a1.* FROM a1 JOIN award_names n ON n.awardee_name = a1.assignee_name), gm AS (SELECT n.ticker, g1.* FROM g1 JOIN award_names n ON n.awardee_name = g1.assignee_name)"""


@query("f17_patents", f"""WITH {_PAT}, s AS (SELECT DISTINCT ticker, date FROM px),
x AS (SELECT s.ticker, s.date, COUNT(*) FILTER (filing_date >= s.date - 90) AS a90, COUNT(*) FILTER (filing_date >= s.date - 180 AND filing_date < s.date - 90) AS pr, COUNT(filing_date) AS a365,
 COUNT(*) FILTER (filing_date >= s.date - 90 AND cpc_group = 'G06N') AS ai FROM s LEFT JOIN am ON am.ticker = s.ticker AND filing_date BETWEEN s.date - 365 AND s.date GROUP BY 1, 2),
y AS (SELECT s.ticker, s.date, COUNT(grant_date) AS g, COALESCE(SUM(fc), 0) AS c FROM s LEFT JOIN gm ON gm.ticker = s.ticker AND grant_date BETWEEN s.date - 365 AND s.date GROUP BY 1, 2)
SELECT ticker, date, CAST(a90 AS DOUBLE) AS patent_app_count_90d, CAST(a90 - pr AS DOUBLE) AS patent_app_momentum, CAST(g AS DOUBLE) AS patent_grant_count_365d,
 ROUND(g / greatest(a365, 1)::DOUBLE, 6) AS patent_grant_rate_365d, ROUND(ai / greatest(a90, 1)::DOUBLE, 6) AS patent_ai_cpc_share_90d, CAST(c AS DOUBLE) AS patent_citation_count_365d FROM x JOIN y USING (ticker, date)""")
def f17(t):
    names = t.award_names.withColumnRenamed("awardee_name", "assignee_name")
    return rounded(ma.patent_features(t.px, t.apps, t.grants, names))


@query("f17b_patent_buckets", """
SELECT quarter_end, cpc_class, COUNT(*) AS filing_count FROM (SELECT last_day(make_date(year(filing_date)::INTEGER, (quarter(filing_date) * 3)::INTEGER, 1)) AS quarter_end,
 CASE WHEN h = 'B25J' OR h SIMILAR TO 'B25J[0-9].*' THEN 'B25J' WHEN h IN ('B64C', 'B64U') OR h SIMILAR TO 'B64[CU][0-9].*' THEN 'B64' WHEN h = 'B60W' OR h SIMILAR TO 'B60W[0-9].*' THEN 'B60W'
 WHEN h = 'G05D1' THEN 'G05D1' WHEN h = 'G05B19' THEN 'G05B19' WHEN h = 'G06V' OR h SIMILAR TO 'G06V[0-9].*' THEN 'G06V' END AS cpc_class
 FROM (SELECT filing_date, split_part(cpc_group, '/', 1) AS h FROM apps)) WHERE cpc_class IS NOT NULL GROUP BY 1, 2""")
def f17b(t):
    return ma.patent_buckets(t.apps, cpc_bucket("cpc_group"))


@query("f18_labor", """
WITH d AS (SELECT DISTINCT date FROM ev0), ev0 AS (SELECT day AS date FROM ev UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem),
h AS (SELECT d.date, COUNT(*) FILTER (posted_date BETWEEN d.date - 30 AND d.date) AS n30, COUNT(*) FILTER (posted_date >= d.date - 60 AND posted_date < d.date - 30) AS pr
  FROM d LEFT JOIN postings1 p ON posted_date BETWEEN d.date - 60 AND d.date GROUP BY 1),
m AS (SELECT make_date(year, substr(period, 2)::INTEGER, 1) AS md, arg_max(value, date) AS v FROM jolts GROUP BY 1),
m1 AS (SELECT md, v, COALESCE(v - LAG(v) OVER (ORDER BY md), 0.0) AS c FROM m)
SELECT h.date, CAST(n30 AS DOUBLE) AS gov_ai_hiring_30d, CAST(n30 - pr AS DOUBLE) AS gov_ai_hiring_momentum, COALESCE(v, 0.0) AS tech_job_openings_index, COALESCE(c, 0.0) AS tech_job_openings_momentum
FROM h ASOF LEFT JOIN m1 ON h.date >= m1.md""".replace("WITH d AS (SELECT DISTINCT date FROM ev0), ev0 AS (SELECT day AS date FROM ev UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem),",
 "WITH ev0 AS (SELECT day AS date FROM ev UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem), d AS (SELECT DISTINCT date FROM ev0),"))
def f18(t):
    days = t.ev.select(F.col("day").alias("date")).unionByName(t.raw("lineitem").select(F.to_date("l_shipdate").alias("date")))
    return rounded(ma.labor_features(days, t.postings, t.jolts))


@query("f19_trade", """
WITH d AS (SELECT DISTINCT date FROM px), t1 AS (SELECT *, make_date(year, month, 1) AS md FROM trade1),
c AS (SELECT md, v, COALESCE(v - LAG(v) OVER (ORDER BY md), 0.0) AS m FROM (SELECT md, SUM(value_usd) / 1e6 AS v FROM t1 WHERE direction = 'import' AND hs_code IN ('8541', '8542') AND partner_code = 'ALL' GROUP BY 1)),
g AS (SELECT md, v, COALESCE(v - LAG(v) OVER (ORDER BY md), 0.0) AS m FROM (SELECT md, SUM(value_usd) / 1e6 AS v FROM t1 WHERE direction = 'import' AND hs_code IN ('8471', '8473') AND partner_code = 'ALL' GROUP BY 1)),
ch AS (SELECT md, SUM(CASE WHEN partner_code = '5700' THEN value_usd ELSE 0.0 END) / greatest(SUM(CASE WHEN partner_code = 'ALL' THEN value_usd ELSE 0.0 END), 1.0) AS s FROM t1 WHERE direction = 'export' AND hs_code IN ('8541', '8542') GROUP BY 1),
tw AS (SELECT md, SUM(CASE WHEN partner_code = '5830' THEN value_usd ELSE 0.0 END) / greatest(SUM(CASE WHEN partner_code = 'ALL' THEN value_usd ELSE 0.0 END), 1.0) AS s FROM t1 WHERE direction = 'import' AND hs_code IN ('8541', '8542') GROUP BY 1),
x1 AS (SELECT d.date, v AS v1, m AS m1 FROM d ASOF LEFT JOIN c ON d.date >= c.md), x2 AS (SELECT x1.*, v AS v2, m AS m2 FROM x1 ASOF LEFT JOIN g ON x1.date >= g.md),
x3 AS (SELECT x2.*, s AS s1 FROM x2 ASOF LEFT JOIN ch ON x2.date >= ch.md), x4 AS (SELECT x3.*, s AS s2 FROM x3 ASOF LEFT JOIN tw ON x3.date >= tw.md)
SELECT date, ROUND(COALESCE(v1, 0.0), 6) AS semicon_import_value, ROUND(COALESCE(m1, 0.0), 6) AS semicon_import_momentum, ROUND(COALESCE(v2, 0.0), 6) AS dc_equipment_import_value,
 ROUND(COALESCE(m2, 0.0), 6) AS dc_equipment_import_momentum, ROUND(COALESCE(s1, 0.0), 6) AS china_semicon_export_share, ROUND(COALESCE(s2, 0.0), 6) AS taiwan_semicon_import_share FROM x4""")
def f19(t):
    return rounded(ma.trade_features(t.px, t.trade))


def _f20_sql() -> str:
    ctes, cols, prev = [], [], "d"
    ctes.append("d AS (SELECT DISTINCT date FROM px), dl AS (SELECT date, date - 365 AS back FROM d)")
    for i, s in enumerate(ma.PHYSICAL_SERIES):
        ctes.append(f"o{i} AS (SELECT date AS od, value AS v FROM obs WHERE series_id = '{s.key}')")
        ctes.append(f"n{i} AS (SELECT dl.date, CASE WHEN dl.date - od <= {s.tolerance_days} THEN v END AS v FROM dl ASOF LEFT JOIN o{i} ON dl.date >= od)")
        cols.append(f"ROUND(n{i}.v, 6) AS {s.level}")
        if s.change:
            ctes.append(f"p{i} AS (SELECT dl.date, CASE WHEN dl.back - od <= {s.tolerance_days} THEN v END AS v FROM dl ASOF LEFT JOIN o{i} ON dl.back >= od)")
            cols.append(f"ROUND((n{i}.v - p{i}.v) / NULLIF(p{i}.v, 0), 6) AS {s.change}")
    joins = " ".join([f"JOIN n{i} USING (date)" + (f" JOIN p{i} USING (date)" if s.change else "") for i, s in enumerate(ma.PHYSICAL_SERIES)])
    return f"WITH {', '.join(ctes)} SELECT d.date, {', '.join(cols)} FROM d {joins}"


@query("f20_physical_ai", _f20_sql())
def f20(t):
    return rounded(ma.series_features(t.px, t.obs, ma.PHYSICAL_SERIES))


@query("f21_ai_economics", """
WITH d AS (SELECT DISTINCT date FROM px), dd AS (SELECT date FROM d UNION SELECT date - 365 FROM d),
e AS (SELECT dd.date, ticker, revenue, capex, row_number() OVER (PARTITION BY dd.date, ticker ORDER BY period_end DESC) AS rn FROM dd JOIN hq ON period_end BETWEEN dd.date - 400 AND dd.date),
p AS (SELECT date, ticker, SUM(revenue) AS r, SUM(capex) AS c, COUNT(*) AS n FROM e WHERE rn <= 4 GROUP BY 1, 2),
tt AS (SELECT date, CASE WHEN MIN(n) = 4 THEN SUM(r) END AS r, CASE WHEN MIN(n) = 4 THEN SUM(c) END AS c FROM p GROUP BY 1)
SELECT d.date, ROUND(CASE WHEN a.r > 0 THEN a.c / a.r END, 6) AS ai_capex_coverage_ratio, ROUND(a.c / 1e9, 6) AS hyperscaler_capex_aggregate,
 ROUND((a.c - b.c) / NULLIF(b.c, 0), 6) AS hyperscaler_capex_yoy FROM d LEFT JOIN tt a ON a.date = d.date LEFT JOIN tt b ON b.date = d.date - 365""")
def f21(t):
    return rounded(fl.ai_economics_features(t.px, t.hq))


@query("f22_label_1y", """SELECT ticker, date, ROUND(f / NULLIF(close_price, 0) - 1, 6) AS label_return_1y
FROM (SELECT *, LEAD(close_price, 252) OVER (PARTITION BY ticker ORDER BY date) AS f FROM px) WHERE f IS NOT NULL""")
def f22(t):
    return rounded(pr.label_1y(t.px))


@query("f22_labels_all", "SELECT ticker, date, " + ", ".join(
    f"ROUND(LEAD(close_price, {n}) OVER w / NULLIF(close_price, 0) - 1, 6) AS label_return_{tag}" for tag, n in pr.HORIZONS.items())
    + " FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def f22_all(t):
    return rounded(pr.labels_all(t.px))
