"""Declared schemas of the source tables. A missing source becomes a typed empty DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


OHLCV = "ticker string, date date, open double, high double, low double, close_price double, volume bigint"
FUNDAMENTAL_COLS = [
    "pe_ratio_trailing", "price_to_sales", "price_to_book", "revenue_growth_yoy", "gross_margin",
    "operating_margin", "capex_to_revenue", "debt_to_equity", "current_ratio", "net_income_margin",
    "free_cash_flow_margin", "capex_growth_yoy", "revenue_growth_accel", "research_to_revenue",
]
TABLES: dict[str, str] = {
    "ohlcv": OHLCV,
    "fundamentals": "ticker string, period_end date, " + ", ".join(f"{c} double" for c in FUNDAMENTAL_COLS),
    "xbrl_fact": "ticker string, concept string, start date, end date, val double, filed date, form string, accn string",
    "insider_trades": "ticker string, filed_date date, transaction_date date, insider_name string, insider_title string, "
                      "transaction_code string, shares double, price_per_share double, value double",
    "congress_trades": "ticker string, trade_date date, politician_name string, chamber string, party string, "
                       "transaction_type string, amount_low double, amount_high double, amount_mid double",
    "short_interest": "date date, ticker string, short_volume double, total_volume double, short_vol_ratio double",
    "earnings": "ticker string, quarter_end date, eps_actual double, eps_estimate double, eps_surprise double, "
                "eps_surprise_pct double",
    "scored_news": "timestamp timestamp, mentioned_tickers array<string>, net_sentiment double, positive double, "
                   "negative double, neutral double, label string",
    "holdings_13f": "cik string, quarter string, period_end date, cusip string, ticker string, shares_held bigint, "
                    "value_usd_thousands bigint",
    "shares_map": "ticker string, shares_outstanding bigint",
    "edges": "ticker_from string, ticker_to string, edge_weight double, deal_count int, last_deal_date date, edge_types string",
    "deals": "date date, party_a string, party_b string, deal_type string, description string, source string, "
             "source_url string, confidence double, deal_mw double, buyer_type string",
    "threats": "date date, source string, metric string, value double",
    "options": "ticker string, date date, expiry date, option_type string, strike double, iv double, oi bigint, volume bigint",
    "awards": "date date, awardee_name string, uei string, contract_value_usd double, naics_code string, agency string",
    "queue": "snapshot_date date, queue_date date, project_name string, mw double, state string, fuel string, "
             "status string, iso string",
    "patent_apps": "date date, assignee_name string, app_id string, cpc_group string, filing_date date",
    "patent_grants": "date date, assignee_name string, patent_id string, cpc_group string, grant_date date, "
                     "forward_citation_count int",
    "patent_buckets": "quarter_end date, cpc_class string, filing_count bigint",
    "postings": "date date, posting_id string, title string, posted_date date, keyword string",
    "jolts": "date date, series_id string, year int, period string, value double",
    "trade": "date date, direction string, hs_code string, partner_code string, year int, month int, value_usd double",
    "macro_series": "series_id string, date date, value double",
    "fx": "pair string, date date, rate double",
    "hyperscaler_q": "ticker string, period_end date, revenue double, capex double",
    "capacity": "date date, fuel_type string, capacity_gw double",
    "zone_queue": "date date, zone string, queue_backlog_gw double, project_count int",
    "country_energy": "country string, year int, renewables_pct double, solar_share_elec double, wind_share_elec double, "
                      "nuclear_share_elec double, electricity_demand double, per_capita_electricity double, "
                      "carbon_intensity_gco2_per_kwh double",
    "geo_exposure": "ticker string, region string, weight double",
    "positions": "timestamp timestamp, mmsi string, imo string, vessel_name string, vessel_type int, latitude double, "
                 "longitude double, speed_knots float, course float, draught float, destination string, corridor string",
    "registry": "ticker string, layer string, exchange string, currency string, country string",
    "predictions": "ticker string, date date, horizon string, rank int, expected_annual_return double, "
                   "confidence_low double, confidence_high double, lgbm_return double, rf_return double, ridge_return double",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))
