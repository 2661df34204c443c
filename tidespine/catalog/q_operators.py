"""Single operators: projections, joins, aggregates, windows, top-k, set operations."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidespine.catalog.base import query
from tidespine.catalog.views import dsum
from tidespine.functions import dates as d, scalar as sc, text as tx
from tidespine.operators import dedup, ranking
from tidespine.operators.asof import asof_change, asof_join
from tidespine.operators.calendar import calendar_change, calendar_index, calendar_lag, fill_gaps, with_calendar
from tidespine.operators.graph import decayed_edges, hops_to_set, neighbour_mean, proximity
from tidespine.operators.intervals import Span, distinct_in_span, interval_rows, span_agg
from tidespine.operators.match import contains_pairs, first_security, fuzzy_pairs, match_names, tag_entities
from tidespine.operators.windows import (full_mean, full_sum, rank_position, realised_volatility, rolling_correlation,
                                         span_return, streak, trailing)
from tidespine.plans import deals as dl, filings as fl, market as mk
from tidespine.plans.attach import spine_of
from tidespine.plans.evaluate import display, hit_rate, pearson
from tidespine.session import cut_lineage
from tidespine.sources import filings as sf

rounded = sc.rounded

# ---- projections, filters, scalar functions -------------------------------------------------------


@query("p01_project", """SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS qty,
 l_extendedprice AS price, 'USD' AS currency FROM lineitem""")
def p01(t):
    return t.raw("lineitem").withColumnRenamed("l_orderkey", "order_id").select(
        "order_id", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.lit("USD").alias("currency"))


@query("p02_predicates", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20
 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O') AND (l_discount > 0.05 OR l_tax IS NULL) AND l_shipdate IS NOT NULL""")
def p02(t):
    c = F.col
    return t.raw("lineitem").where(
        c("l_quantity").between(10, 20) & c("l_returnflag").isin("A", "R") & ~(c("l_linestatus") == "O")
        & ((c("l_discount") > 0.05) | c("l_tax").isNull()) & c("l_shipdate").isNotNull()).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("p03_safe_ratio", "SELECT l_orderkey, l_linenumber, ROUND(l_discount / NULLIF(l_tax, 0), 9) AS r, ROUND(l_discount / NULLIF(l_tax, 0) - 1, 9) AS chg FROM lineitem")
def p03(t):
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", sc.ratio("l_discount", "l_tax").alias("r"),
                                            sc.change("l_discount", "l_tax").alias("chg")), 9)


@query("p04_case", """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'middle' ELSE 'large' END AS band, COUNT(*) AS n
 FROM lineitem GROUP BY 1""")
def p04(t):
    band = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 40, "middle").otherwise("large")
    return t.raw("lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p05_null_handling", """SELECT doc_id, COALESCE(net_sentiment, 0.0) AS filled, net_sentiment IS NULL AS missing,
 COALESCE(label, 'unscored') AS label FROM news WHERE mentioned_tickers IS NOT NULL""")
def p05(t):
    return t.news.dropna(subset=["mentioned_tickers"]).select(
        "doc_id", sc.zero_fill("net_sentiment").alias("filled"), F.col("net_sentiment").isNull().alias("missing"),
        F.coalesce("label", F.lit("unscored")).alias("label"))


@query("p06_clip", """SELECT doc_id, CASE WHEN net_sentiment IS NOT NULL THEN least(greatest(net_sentiment, -0.5), 0.5) END::DOUBLE AS clipped,
 greatest(n_chars, 1000) AS floored, least(n_chars, 1000) AS capped FROM documents JOIN news USING (doc_id)""")
def p06(t):
    d0 = t.raw("documents").select("doc_id", "n_chars").join(t.news.select("doc_id", "net_sentiment"), "doc_id")
    return d0.select("doc_id", sc.clip(F.col("net_sentiment"), -0.5, 0.5).alias("clipped"),
                     F.greatest("n_chars", F.lit(1000).cast("long")).alias("floored"),
                     F.least("n_chars", F.lit(1000).cast("long")).alias("capped"))


@query("p07_math", """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(sign(l_tax - 0.04) AS DOUBLE) AS s, ROUND(ln(l_extendedprice), 6) AS l,
 ROUND(sqrt(l_quantity), 6) AS q, ROUND(power(0.5, l_quantity / 365.25), 6) AS p, ROUND(l_extendedprice, 1) AS r FROM lineitem""")
def p07(t):
    c = F.col
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(c("l_discount") - 0.05).alias("a"), F.signum(c("l_tax") - 0.04).alias("s"),
        F.round(F.ln("l_extendedprice"), 6).alias("l"), F.round(F.sqrt("l_quantity"), 6).alias("q"),
        F.round(F.pow(F.lit(0.5), c("l_quantity") / 365.25), 6).alias("p"), F.round("l_extendedprice", 1).alias("r"))


@query("p08_dates", """SELECT o_orderkey, day - 90 AS back, day + 30 AS ahead, CAST(date_trunc('month', day) AS DATE) AS month_start,
 CAST(date_trunc('week', day) AS DATE) AS week_start, last_day(make_date(year(day)::INTEGER, (quarter(day) * 3)::INTEGER, 1)) AS quarter_end,
 last_day(make_date(year(day - INTERVAL 3 MONTH)::INTEGER, (quarter(day - INTERVAL 3 MONTH) * 3)::INTEGER, 1)) AS prior_quarter_end,
 make_date(year(day)::INTEGER, CASE WHEN month(day) <= 6 THEN 1 ELSE 7 END, 1) AS half_year, isodow(day) >= 6 AS weekend,
 year(day)::VARCHAR || 'Q' || quarter(day)::VARCHAR AS quarter_name FROM ord""")
def p08(t):
    return t.ord.select(
        "o_orderkey", F.date_sub("day", 90).alias("back"), F.date_add("day", 30).alias("ahead"), F.trunc("day", "month").alias("month_start"),
        F.trunc("day", "week").alias("week_start"), d.quarter_end("day").alias("quarter_end"),
        d.prior_quarter_end("day").alias("prior_quarter_end"), d.half_year_start("day").alias("half_year"),
        d.is_weekend("day").alias("weekend"), d.quarter_label("day").alias("quarter_name"))


_FACT_KEEP = """SELECT ticker, concept, "start", "end", val, filed, form FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, "end"
 ORDER BY filed DESC, "start" DESC, val DESC) AS rn FROM facts WHERE "end" - "start" BETWEEN {lo} AND {hi}) WHERE rn = 1"""


@query("p09_period_filter", _FACT_KEEP.format(lo=75, hi=105))
def p09(t):
    return fl.period_facts(t.facts, *fl.QUARTER_DAYS)


@query("p10_concept_fallback", """WITH pr(concept, measure, rank) AS (VALUES ('SalesRevenueNet', 'revenue', 0), ('Revenues', 'revenue', 1), ('GrossProfit', 'gross_profit', 0)),
 f AS (SELECT facts.*, measure, rank FROM facts JOIN pr USING (concept) WHERE NOT (concept = 'SalesRevenueNet' AND ticker < 'NATION_2')),
 b AS (SELECT ticker, measure, MIN(rank) AS rank FROM f GROUP BY 1, 2)
 SELECT ticker, measure, concept, COUNT(*) AS n, CAST(SUM(CAST(val AS DECIMAL(18,2))) AS DOUBLE) AS total FROM f JOIN b USING (ticker, measure, rank) GROUP BY 1, 2, 3""")
def p10(t):
    priority = t.spark.createDataFrame([("SalesRevenueNet", "revenue", 0), ("Revenues", "revenue", 1), ("GrossProfit", "gross_profit", 0)],
                                       "concept string, measure string, rank int")
    facts = t.facts.where(~((F.col("concept") == "SalesRevenueNet") & (F.col("ticker") < "NATION_2")))
    return fl.first_concept(facts, priority).groupBy("ticker", "measure", "concept").agg(
        F.count(F.lit(1)).alias("n"), dsum(F.col("val")).alias("total"))


def _strip_suffixes_sql() -> str:
    inner = ("SELECT DISTINCT raw, trim(lower(raw)) AS s FROM (SELECT p_name || CASE p_size % 6 WHEN 0 THEN ' Holdings Inc' WHEN 1 THEN ' Systems LLC' "
             "WHEN 2 THEN ' Co' WHEN 3 THEN ' Technologies Limited' WHEN 4 THEN ' Corporation ' ELSE '' END AS raw FROM part)")
    for suffix in tx.LEGAL_SUFFIXES:
        inner = f"SELECT raw, CASE WHEN ends_with(s, '{suffix}') THEN trim(left(s, length(s) - {len(suffix)})) ELSE s END AS s FROM ({inner})"
    return f"SELECT raw, s AS name FROM ({inner})"


def raw_names(t):
    tail = sc.lookup((F.col("p_size") % 6).cast("string"), {"0": " Holdings Inc", "1": " Systems LLC", "2": " Co",
                                                             "3": " Technologies Limited", "4": " Corporation "}, "")
    return t.raw("part").select(F.concat("p_name", tail).alias("raw")).distinct()


@query("p11_normalize_name", _strip_suffixes_sql())
def p11(t):
    return raw_names(t).select("raw", tx.normalize_name("raw").alias("name"))


@query("p12_strip_markup", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def p12(t):
    return t.raw("pages").select("page_id", tx.strip_markup("html").alias("text"))


@query("p13_arrays", """SELECT doc_id, list_contains(mentioned_tickers, 'NATION_3') AS hit, CAST(len(mentioned_tickers) AS INTEGER) AS n,
 array_to_string(list_sort(list_distinct(mentioned_tickers)), '|') AS joined FROM news""")
def p13(t):
    m = "mentioned_tickers"
    return t.news.select("doc_id", F.array_contains(m, "NATION_3").alias("hit"), F.size(m).alias("n"),
                         F.array_join(F.array_sort(F.array_distinct(m)), "|").alias("joined"))


@query("p13_unnest", "SELECT ticker, COUNT(*) AS articles FROM tagged GROUP BY 1")
def p13_unnest(t):
    return t.news.select(F.explode("mentioned_tickers").alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("articles"))


@query("p14_lookup", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hyperscaler' WHEN 'BUILDING' THEN 'utility' ELSE 'other' END AS kind, COALESCE(layer, 'none') AS layer
 FROM customer LEFT JOIN nat ON c_nationkey = n_nationkey""")
def p14(t):
    c = t.raw("customer").join(t.nat, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", sc.lookup("c_mktsegment", {"AUTOMOBILE": "hyperscaler", "BUILDING": "utility"}, "other").alias("kind"),
                    F.coalesce("layer", F.lit("none")).alias("layer"))


ALIASES = {"ARTICLE": ["the", "le", "der"], "PREP": ["by the", "for", "avec"], "NEAR": ["by", "the ar"], "VERB": ["ist", "est"]}


def _tag_sql() -> str:
    edge = r"[^\p{L}\p{N}_]"
    parts = [f"CASE WHEN regexp_matches(lower(text), '(^|{edge})({'|'.join(names)})($|{edge})') THEN '{k}' END" for k, names in ALIASES.items()]
    return f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), ',') AS tags FROM documents"


@query("p15_entity_tags", _tag_sql())
def p15(t):
    aliases = t.spark.createDataFrame([(k, name) for k, names in ALIASES.items() for name in names], "entity string, alias string")
    tagged = tag_entities(t.raw("documents").select("doc_id", "text"), F.col("text"), aliases)
    return tagged.select("doc_id", F.array_join("tags", ",").alias("tags"))


def _classify_sql(keywords, default, expr):
    whens = " ".join(f"WHEN regexp_matches(lower({expr}), '{'|'.join(w for w in ws)}') THEN '{k}'" for k, ws in keywords.items())
    return f"CASE {whens} ELSE '{default}' END"


@query("p16_deal_type", f"SELECT filing_id, {_classify_sql(tx.DEAL_KEYWORDS, 'customer_contract', 'text')} AS deal_type, {_classify_sql(tx.BUYER_KEYWORDS, 'other', 'text')} AS buyer_type FROM filing")
def p16(t):
    return t.filing.select("filing_id", tx.deal_type("text").alias("deal_type"), tx.buyer_type("text").alias("buyer_type"))


@query("p17_deal_mw", r"""SELECT filing_id, COALESCE(TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]*(?:\.\d+)?)\s*-?\s*(?:GW|gigawatt)', 1), ',', '') AS DOUBLE) * 1000,
 TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]*(?:\.\d+)?)\s*-?\s*(?:MW|megawatt)', 1), ',', '') AS DOUBLE)) AS mw FROM filing""")
def p17(t):
    return t.filing.select("filing_id", tx.deal_mw("text").alias("mw"))


@query("p18_mention_sentence", r"""SELECT filing_id, left(COALESCE(trim(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: contains(lower(s), 'nation_1'))[1]),
 trim(left(text, 200))), 300) AS sentence FROM filing""")
def p18(t):
    return t.filing.select("filing_id", tx.mention_sentence("text", F.lit("nation_1")).alias("sentence"))


_BAND = """CASE l_linenumber WHEN 1 THEN 'Over $1,000,000' WHEN 2 THEN '$' || CAST(l_quantity AS INTEGER)::VARCHAR || ',001 - $' || CAST(l_quantity AS INTEGER)::VARCHAR || ',900'
 WHEN 3 THEN '$' || CAST(l_quantity AS INTEGER)::VARCHAR ELSE 'n/a' END"""


@query("p19_amount_band", f"""SELECT l_orderkey, l_linenumber, band, CASE l_linenumber WHEN 1 THEN 1500000.0 WHEN 2 THEN (q * 1000 + 1 + q * 1000 + 900) / 2.0 WHEN 3 THEN q END::DOUBLE AS mid
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, {_BAND} AS band FROM lineitem)""")
def p19(t):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    band = (F.when(n == 1, "Over $1,000,000").when(n == 2, F.concat(F.lit("$"), q, F.lit(",001 - $"), q, F.lit(",900")))
            .when(n == 3, F.concat(F.lit("$"), q)).otherwise("n/a"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", band.alias("band")).withColumn("mid", tx.amount_band("band"))


_BOX = " ".join(f"WHEN latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {e} THEN '{k}'" for k, (a, b, c, e) in tx.CORRIDORS.items())


@query("p20_corridor", f"SELECT CASE {_BOX} ELSE 'other' END AS corridor, COUNT(*) AS n, COUNT(DISTINCT mmsi) AS vessels FROM positions GROUP BY 1")
def p20(t):
    return t.positions.groupBy(tx.corridor("latitude", "longitude").alias("corridor")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("mmsi").alias("vessels"))


@query("p21_class_bucket", """SELECT cpc_group, CASE cpc_group WHEN 'B25J9/02' THEN 'B25J' WHEN 'G05D1/02' THEN 'G05D1' WHEN 'B64C39/00' THEN 'B64'
 WHEN 'G06V10/10' THEN 'G06V' END AS bucket, COUNT(*) AS n FROM apps GROUP BY 1, 2""")
def p21(t):
    return t.apps.groupBy("cpc_group", tx.cpc_bucket("cpc_group").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("p22_security_id", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'S' || lpad(c_custkey::VARCHAR, 8, '0') WHEN c_nationkey < 20 THEN lpad(c_custkey::VARCHAR, 9, '0') END AS security FROM customer""")
def p22(t):
    key = F.col("c_custkey").cast("string")
    static = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("S"), F.lpad(key, 8, "0")))
    isin = F.concat(F.when(F.col("c_nationkey") < 20, "US").otherwise("GB"), F.lpad(key, 9, "0"), F.lit("1"))
    return t.raw("customer").select("c_custkey", tx.security_id(static, isin).alias("security"))


@query("p23_any_not_null", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def p23(t):
    return t.raw("documents").join(t.raw("labels"), "doc_id", "left").where(sc.any_not_null("quality", "toxic")).select("doc_id")


@query("p25_display", """SELECT ticker, horizon, ROUND(expected_annual_return * 100, 1) AS expected_pct, ROUND(rf_return * 100, 1) AS low_pct, ROUND(ridge_return * 100, 1) AS high_pct,
 ROUND((ridge_return - rf_return) * 100, 1) AS width_pct FROM preds""")
def p25(t):
    return display(t.preds.withColumnRenamed("rf_return", "confidence_low").withColumnRenamed("ridge_return", "confidence_high"))


@query("p26_undirected_pair", "SELECT least(party_a, party_b) AS a, greatest(party_a, party_b) AS b, COUNT(*) AS n FROM deals GROUP BY 1, 2")
def p26(t):
    lo, hi = sc.undirected_key("party_a", "party_b")
    return t.deals.groupBy(lo.alias("a"), hi.alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("p27_first_present", "SELECT ticker, period_end, COALESCE(rd_expense, current_liabilities, capex) AS value FROM fq")
def p27(t):
    cols = t.fq.columns
    return t.fq.select("ticker", "period_end", sc.first_present(cols, "not_there", "rd_expense", "current_liabilities", "capex").alias("value"))


# ---- joins -----------------------------------------------------------------------------------------


@query("j01_asof_by_key", "SELECT o_orderkey, o.ticker, o.day, short_vol_ratio FROM (SELECT o_orderkey, ticker, day FROM ord) o ASOF LEFT JOIN si ON o.ticker = si.ticker AND o.day >= si.date")
def j01(t):
    return asof_join(t.ord.select("o_orderkey", "ticker", "day"), t.si, on="day", right_on="date", by=["ticker"])


@query("j01_asof_timestamp", """SELECT e.event_id, e.user_id, p.value AS last_purchase, p.ts AS purchased_at FROM (SELECT * FROM events WHERE event_type = 'error') e
 ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def j01_ts(t):
    e = t.raw("events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    p = t.raw("events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("pts"), F.col("value").alias("last_purchase"))
    return asof_join(e, p, on="ts", right_on="pts", by=["user_id"], bucket_seconds=3600, matched_on="purchased_at").drop("ts")


@query("j02_asof_tolerance", """SELECT o_orderkey, CASE WHEN o.day - er.quarter_end <= 30 THEN eps_actual END AS eps_actual FROM (SELECT o_orderkey, ticker, day FROM ord) o
 ASOF LEFT JOIN er ON o.ticker = er.ticker AND o.day >= er.quarter_end""")
def j02(t):
    return asof_join(t.ord.select("o_orderkey", "ticker", "day"), t.er, on="day", right_on="quarter_end", by=["ticker"],
                     cols=["eps_actual"], tolerance_days=30).select("o_orderkey", "eps_actual")


@query("j03_asof_level_yoy", """WITH d AS (SELECT DISTINCT date, date - 365 AS back FROM px), s AS (SELECT date AS sd, value FROM obs WHERE series_id = 'B64'),
 a AS (SELECT d.date, d.back, CASE WHEN d.date - sd <= 60 THEN value END AS v FROM d ASOF LEFT JOIN s ON d.date >= sd),
 b AS (SELECT a.*, CASE WHEN a.back - sd <= 60 THEN value END AS p FROM a ASOF LEFT JOIN s ON a.back >= sd)
 SELECT date, v AS level, ROUND((v - p) / NULLIF(p, 0), 6) AS yoy FROM b""")
def j03(t):
    out = asof_change(t.px, t.obs.where("series_id = 'B64'"), "date", "date", "value", level="level", change="yoy", tolerance_days=60)
    return out.withColumn("yoy", F.round("yoy", 6))


@query("j04_asof_theta", """SELECT px.ticker, px.date, eps_actual FROM (SELECT ticker, date FROM px) px ASOF LEFT JOIN er ON px.ticker = er.ticker AND px.date >= er.quarter_end""")
def j04(t):
    return asof_join(spine_of(t.px), t.er, on="date", right_on="quarter_end", by=["ticker"], cols=["eps_actual"])


@query("j04_asof_lagged", """SELECT px.ticker, px.date, eps_actual FROM (SELECT ticker, date FROM px) px ASOF LEFT JOIN er ON px.ticker = er.ticker AND px.date - 45 >= er.quarter_end""")
def j04_lag(t):
    return asof_join(spine_of(t.px), t.er, on="date", right_on="quarter_end", by=["ticker"], cols=["eps_actual"], lag_days=45)


@query("j05_period_end_price", "SELECT fq.ticker, period_end, close_price FROM fq ASOF LEFT JOIN px ON fq.ticker = px.ticker AND fq.period_end >= px.date")
def j05(t):
    return asof_join(t.fq.select("ticker", "period_end"), t.px.select("ticker", "date", "close_price"), on="period_end", right_on="date",
                     by=["ticker"], left_unique=True)


@query("j06_interval_keyed", """WITH s AS (SELECT DISTINCT ticker, date FROM px) SELECT s.ticker, s.date, CAST(SUM(value) AS DOUBLE) AS total, COUNT(value) AS n, CAST(MIN(value) AS DOUBLE) AS lo, CAST(MAX(value) AS DOUBLE) AS hi
 FROM s LEFT JOIN tr ON tr.ticker = s.ticker AND transaction_date BETWEEN s.date - 14 AND s.date - 8 GROUP BY 1, 2""")
def j06(t):
    v = F.col("value")
    s = span_agg(t.px, t.tr, ["ticker"], "date", [Span("total", "sum", v, -14, -8), Span("n", "count", v, -14, -8),
                                                 Span("lo", "min", v, -14, -8), Span("hi", "max", v, -14, -8)], facts_on="transaction_date")
    return s.withColumns({c: F.col(c).cast("double") for c in ("total", "lo", "hi")})


@query("j06_interval_rows", """SELECT fq.ticker, fq.period_end, px.date AS fact_day, close_price FROM fq JOIN px ON px.ticker = fq.ticker AND px.date BETWEEN fq.period_end - 30 AND fq.period_end""")
def j06_rows(t):
    return interval_rows(t.fq.select("ticker", "period_end"), t.px.select("ticker", "date", "close_price"), ["ticker"], "period_end", -30, 0, right_on="date").drop("date")


@query("j07_interval_global", """WITH d AS (SELECT DISTINCT date FROM px), m AS (SELECT date AS md, AVG(short_vol_ratio) AS v FROM si GROUP BY 1)
 SELECT d.date, ROUND(AVG(v), 9) AS mean, COUNT(v) AS days FROM d LEFT JOIN m ON md BETWEEN d.date - 7 AND d.date GROUP BY 1""")
def j07(t):
    m = t.si.groupBy("date").agg(F.avg("short_vol_ratio").alias("v"))
    return rounded(span_agg(t.px, m, [], "date", [Span("mean", "avg", F.col("v"), -7), Span("days", "count", F.col("v"), -7)]), 9)


@query("j08_latest_and_previous", """WITH m AS (SELECT make_date(year, substr(period, 2)::INTEGER, 1) AS md, arg_max(value, date) AS v FROM jolts GROUP BY 1),
 m1 AS (SELECT md, v, COALESCE(v - LAG(v) OVER (ORDER BY md), 0.0) AS c FROM m), d AS (SELECT DISTINCT date FROM px)
 SELECT d.date, v AS level, c AS change FROM d ASOF LEFT JOIN m1 ON d.date >= md""")
def j08(t):
    from tidespine.plans.macro import latest_month

    months = dedup.keep_latest(t.jolts, ["year", "period"], ["date"]).select(
        d.month_period(F.col("year"), F.col("period")).alias("m"), F.col("value").alias("v"))
    return latest_month(t.px, months, "m", {"v": "level"}, {"v": "change"})


@query("j09_inner_two_keys", "SELECT px.ticker, px.date, close_price, short_vol_ratio FROM px JOIN si USING (ticker, date)")
def j09(t):
    return t.px.join(t.si, ["ticker", "date"]).select("ticker", "date", "close_price", "short_vol_ratio")


@query("j10_left", "SELECT px.ticker, px.date, close_price, COALESCE(short_vol_ratio, 0.0) AS short_vol_ratio FROM px LEFT JOIN si USING (ticker, date)")
def j10(t):
    return t.px.join(t.si, ["ticker", "date"], "left").select("ticker", "date", "close_price", sc.zero_fill("short_vol_ratio").alias("short_vol_ratio"))


@query("j11_full_outer", "SELECT ticker, date, close_price, short_vol_ratio FROM px FULL JOIN si USING (ticker, date)")
def j11(t):
    return t.px.join(t.si, ["ticker", "date"], "full").select("ticker", "date", "close_price", "short_vol_ratio")


@query("j12_semi", "SELECT ticker, date FROM px WHERE ticker IN (SELECT ticker FROM nat WHERE layer = 'ASIA')")
def j12(t):
    return t.px.join(t.layers.where("layer = 'ASIA'"), "ticker", "left_semi").select("ticker", "date")


@query("j13_anti", "SELECT px.ticker, px.date FROM px ANTI JOIN si USING (ticker, date)")
def j13(t):
    return t.px.join(t.si, ["ticker", "date"], "left_anti").select("ticker", "date")


@query("j14_prior_year", """SELECT a.ticker, a.period_end, a.revenue, b.revenue AS prior FROM fq a LEFT JOIN fq b ON a.ticker = b.ticker AND year(a.period_end) = year(b.period_end) + 1 AND quarter(a.period_end) = quarter(b.period_end)""")
def j14(t):
    a = t.fq.select("ticker", "period_end", "revenue", F.year("period_end").alias("y"), F.quarter("period_end").alias("q"))
    prior = dedup.keep_latest(a, ["ticker", "y", "q"], ["period_end"]).select("ticker", (F.col("y") + 1).alias("y"), "q", F.col("revenue").alias("prior"))
    return a.join(prior, ["ticker", "y", "q"], "left").drop("y", "q")


_EDGES = """e0 AS (SELECT least(party_a, party_b) AS a, greatest(party_a, party_b) AS b, SUM(confidence * power(0.5, (DATE '2001-12-31' - date) / 365.25)) AS w, COUNT(*) AS n,
 MAX(date) AS last_deal_date, array_to_string(list_sort(list_distinct(array_agg(deal_type))), '|') AS edge_types FROM deals GROUP BY 1, 2),
 e AS (SELECT a AS ticker_from, b AS ticker_to, w AS edge_weight, n AS deal_count, last_deal_date, edge_types FROM e0 UNION ALL SELECT b, a, w, n, last_deal_date, edge_types FROM e0)"""


@query("j15_neighbour_mean", f"""WITH {_EDGES}, s AS (SELECT ticker, date, short_vol_ratio AS v FROM si)
 SELECT e.ticker_from AS ticker, s.date, ROUND(SUM(edge_weight * v) / SUM(edge_weight), 9) AS neighbour_ratio FROM e JOIN s ON s.ticker = e.ticker_to GROUP BY 1, 2""")
def j15(t):
    return rounded(neighbour_mean(t.si, decayed_edges(t.deals, "2001-12-31"), "short_vol_ratio", "neighbour_ratio"), 9)


@query("j16_fuzzy_names")
def j16(t):
    names = raw_names(t)
    targets = t.spark.createDataFrame([("T1", "Small Ring Inc"), ("T2", "red wigdet"), ("T3", "larg gears corp"), ("T4", "hot plates"),
                                       ("T5", "old anvil systems"), ("T6", "nothing alike")], "ticker string, search_name string")
    return match_names(names, targets, all_names=True)


@query("j16_fuzzy_pairs")
def j16_pairs(t):
    """Supplier names against customer names with the same digits dropped or moved: many near copies."""
    a = t.raw("supplier").select(F.lower("s_name").alias("name"))
    b = t.raw("part").select(F.concat(F.lit("supplier"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 9, "0")).alias("alias")).distinct()
    return rounded(fuzzy_pairs(a, b, 0.9), 6)


@query("j17_contains_first", """WITH h AS (SELECT p_partkey AS ord, 'C' || lpad(p_partkey::VARCHAR, 8, '0') AS cusip, regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g') AS n FROM part),
 p(ticker, pattern) AS (VALUES ('T1', 'ring'), ('T1', 'gear'), ('T2', 'hot p'), ('T3', 'zzz'), ('T4', 'anvil'))
 SELECT ticker, arg_min(cusip, ord) AS cusip FROM h JOIN p ON contains(n, pattern) GROUP BY 1""")
def j17(t):
    h = t.raw("part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("cusip"), F.col("p_name").alias("issuer"))
    p = t.spark.createDataFrame([("T1", "Ring"), ("T1", "gear!"), ("T2", "hot p"), ("T3", "zzz"), ("T4", "anvil")], "ticker string, pattern string")
    return first_security(h, p)


@query("j17_contains_words", """SELECT doc_id, w AS word FROM documents, (VALUES ('tion'), ('the re'), ('que'), ('eau'), ('ing')) v(w) WHERE contains(lower(text), w)""")
def j17_words(t):
    docs = t.raw("documents").select("doc_id", F.lower("text").alias("low"))
    p = t.spark.createDataFrame([("tion",), ("the re",), ("que",), ("eau",), ("ing",)], "word string")
    return contains_pairs(docs, p, "low", "word", ["doc_id"])


@query("j17_contains_grams", """SELECT doc_id, p AS pattern FROM (SELECT DISTINCT text AS p FROM benchmark), documents WHERE contains(documents.text, p)""")
def j17_grams(t):
    docs = t.raw("documents").select("doc_id", "text")
    return contains_pairs(docs, t.raw("benchmark").select(F.col("text").alias("pattern")), "text", "pattern", ["doc_id"])


_KW = _classify_sql(tx.DEAL_KEYWORDS, "customer_contract", "text")
_MW = r"""COALESCE(TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]*(?:\.\d+)?)\s*-?\s*(?:GW|gigawatt)', 1), ',', '') AS DOUBLE) * 1000,
 TRY_CAST(replace(regexp_extract(text, '(?i)(\d[\d,]*(?:\.\d+)?)\s*-?\s*(?:MW|megawatt)', 1), ',', '') AS DOUBLE))"""
_TEXT_DEALS = f"""td AS (SELECT f.filing_id, f.date, filer_ticker AS party_a, c.ticker AS party_b, {_KW} AS deal_type,
 left(COALESCE(trim(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: contains(lower(s), c.company_name))[1]), trim(left(text, 200))), 300) AS description,
 '8-K' AS source, url AS source_url, 0.7::DOUBLE AS confidence, {_MW} AS deal_mw, 'other' AS buyer_type
 FROM filing f JOIN companies c ON contains(lower(text), c.company_name) WHERE c.ticker <> filer_ticker)"""


@query("j18_text_mentions", f"WITH {_TEXT_DEALS} SELECT * FROM td")
def j18(t):
    return dl.text_deals(t.filing, t.companies)


@query("j19_audit_ids", """WITH o AS (SELECT c_name AS ticker, c_custkey AS our, c_custkey % 7 <> 0 AS ok, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey + 1) % 1500 WHEN c_custkey % 5 = 1 THEN NULL ELSE c_custkey END AS theirs FROM customer),
 f AS (SELECT o_custkey AS cik, MAX(CAST(o_orderdate AS DATE)) AS filed FROM orders GROUP BY 1),
 x AS (SELECT o.*, a.filed AS fa, CASE WHEN theirs <> our THEN b.filed END AS fb FROM o LEFT JOIN f a ON a.cik = our LEFT JOIN f b ON b.cik = theirs),
 y AS (SELECT *, CASE WHEN NOT ok THEN 'broken' WHEN fa IS NULL AND fb IS NOT NULL THEN 'stale' WHEN fb - fa > 30 THEN 'stale' WHEN fb - fa > 0 THEN 'minor' WHEN theirs <> our THEN 'minor' ELSE 'ok' END AS severity FROM x)
 SELECT ticker, our AS our_cik, theirs AS sec_cik, fa AS our_latest, fb AS sec_latest, severity, CASE WHEN severity IN ('broken', 'stale') THEN theirs END AS suggested_cik FROM y""")
def j19(t):
    c = t.raw("customer").select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik"), (F.col("c_custkey") % 7 != 0).alias("reachable"))
    k = F.col("cik")
    theirs = c.where(k % 5 != 1).select("ticker", F.when(k % 5 == 0, (k + 1) % 1500).otherwise(k).alias("cik"))
    filings = t.raw("orders").select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed"))
    return sf.audit_ids(c, theirs, filings)


# ---- aggregates ------------------------------------------------------------------------------------


@query("a01_sum_count", "SELECT ticker, day AS date, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n FROM li GROUP BY 1, 2")
def a01(t):
    return t.li.groupBy("ticker", F.col("day").alias("date")).agg(dsum(F.col("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("a02_count_distinct", "SELECT ticker, quarter, COUNT(DISTINCT cik) AS holders FROM hold GROUP BY 1, 2")
def a02(t):
    return t.hold.groupBy("ticker", "quarter").agg(F.count_distinct("cik").alias("holders"))


@query("a02_distinct_in_window", """WITH s AS (SELECT DISTINCT ticker, date FROM px) SELECT s.ticker, s.date, COUNT(DISTINCT insider_name) AS members
 FROM s LEFT JOIN tr ON tr.ticker = s.ticker AND transaction_date BETWEEN s.date - 30 AND s.date GROUP BY 1, 2""")
def a02_window(t):
    return distinct_in_span(t.px, t.tr, ["ticker"], "date", "insider_name", 30, "members", facts_on="transaction_date")


@query("a03_conditional", """SELECT ticker, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS returned,
 COUNT(*) FILTER (l_linestatus = 'O') AS open_lines, ROUND(AVG(CASE WHEN l_quantity > 25 THEN l_discount END), 9) AS big_discount FROM li GROUP BY 1""")
def a03(t):
    c = F.col
    return rounded(t.li.groupBy("ticker").agg(
        dsum(F.when(c("l_returnflag") == "R", c("l_extendedprice")).otherwise(0)).alias("returned"),
        F.count_if(c("l_linestatus") == "O").alias("open_lines"), F.avg(F.when(c("l_quantity") > 25, c("l_discount"))).alias("big_discount")), 9)


@query("a04_avg_stddev", "SELECT ticker, day AS date, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd FROM li GROUP BY 1, 2")
def a04(t):
    return rounded(t.li.groupBy("ticker", F.col("day").alias("date")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")))


@query("a05_top_k_share", """SELECT ticker, quarter, CAST(SUM(shares_held) FILTER (r <= 10) AS BIGINT) AS top10, ROUND(SUM(shares_held) FILTER (r <= 10)::DOUBLE / SUM(shares_held)::DOUBLE, 9) AS share
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker, quarter ORDER BY shares_held DESC) AS r FROM hold) GROUP BY 1, 2""")
def a05(t):
    w = Window.partitionBy("ticker", "quarter").orderBy(F.col("shares_held").desc())
    top = (t.hold.select("ticker", "quarter", "shares_held").withColumn("r", F.row_number().over(w)).where("r <= 10")
           .groupBy("ticker", "quarter").agg(F.sum("shares_held").alias("top10")))
    total = t.hold.groupBy("ticker", "quarter").agg(F.sum("shares_held").alias("total"))
    return rounded(top.join(total, ["ticker", "quarter"]).select("ticker", "quarter", "top10", sc.ratio("top10", "total").alias("share")), 9)


@query("a06_latest_value", "SELECT fuel_type, MAX(date) AS date, arg_max(capacity_gw, date) AS capacity_gw FROM capacity GROUP BY 1")
def a06(t):
    return t.capacity.groupBy("fuel_type").agg(F.max("date").alias("date"), F.max_by("capacity_gw", "date").alias("capacity_gw"))


@query("a07_median", "SELECT ticker, MEDIAN(l_extendedprice) AS mid, quantile_cont(l_extendedprice, 0.9) AS p90, MEDIAN(l_quantity) AS qty FROM li GROUP BY 1")
def a07(t):
    a = ranking.exact_quantiles(t.li, ["ticker"], "l_extendedprice", {"mid": 0.5, "p90": 0.9})
    return a.join(ranking.exact_median(t.li, ["ticker"], "l_quantity", "qty"), "ticker")


@query("a08_feature_medians", "SELECT feature, ROUND(MEDIAN(value), 9) AS median FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY 1")
def a08(t):
    from tidespine.plans.models import medians

    found = medians(t.raw("lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return rounded(t.spark.createDataFrame(sorted(found.items()), "feature string, median double"), 9)


@query("a09_pearson", """SELECT layer, ROUND(corr(l_quantity, l_extendedprice), 6) AS r, COUNT(*) AS n FROM li GROUP BY 1""")
def a09(t):
    return rounded(t.li.groupBy("layer").agg(pearson("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n")))


@query("a10_weighted_mean", "SELECT ticker, ROUND(SUM(l_quantity * rd) / NULLIF(SUM(CASE WHEN rd IS NOT NULL THEN l_quantity END), 0), 6) AS wmean FROM (SELECT ticker, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_discount END AS rd FROM li) GROUP BY 1")
def a10(t):
    v = F.when(F.col("l_returnflag") == "R", F.col("l_discount"))
    w = F.col("l_quantity")
    return rounded(t.li.groupBy("ticker").agg(sc.ratio(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))).alias("wmean")))


@query("a11_decayed_edges", f"WITH {_EDGES} SELECT ticker_from, ticker_to, ROUND(edge_weight, 6) AS edge_weight, deal_count, last_deal_date, edge_types FROM e")
def a11(t):
    return rounded(decayed_edges(t.deals, "2001-12-31"))


@query("a12_complete_totals", """WITH dd AS (SELECT DISTINCT date FROM px), e AS (SELECT dd.date, ticker, revenue, capex, row_number() OVER (PARTITION BY dd.date, ticker ORDER BY period_end DESC) AS rn FROM dd JOIN hq ON period_end BETWEEN dd.date - 380 AND dd.date),
 p AS (SELECT date, ticker, SUM(revenue) AS r, SUM(capex) AS c, COUNT(*) AS n FROM e WHERE rn <= 4 GROUP BY 1, 2)
 SELECT dd.date, ROUND(CASE WHEN MIN(n) = 4 THEN SUM(r) END, 2) AS revenue, ROUND(CASE WHEN MIN(n) = 4 THEN SUM(c) END, 4) AS capex FROM dd LEFT JOIN p USING (date) GROUP BY 1""")
def a12(t):
    out = fl.trailing_totals(t.hq, t.px.select("date").distinct(), 380)
    return out.select("date", F.round("revenue", 2).alias("revenue"), F.round("capex", 4).alias("capex"))


@query("a13_min_max_scale", "SELECT ticker, date, ROUND(CASE WHEN hi = lo THEN 0.5 ELSE (close_price - lo) / (hi - lo) END, 9) AS pos FROM px JOIN (SELECT ticker, MIN(close_price) AS lo, MAX(close_price) AS hi FROM px GROUP BY 1) USING (ticker)")
def a13(t):
    ends = t.px.groupBy("ticker").agg(F.min("close_price").alias("lo"), F.max("close_price").alias("hi"))
    pos = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(sc.ratio(F.col("close_price") - F.col("lo"), F.col("hi") - F.col("lo")))
    return rounded(t.px.join(ends, "ticker").select("ticker", "date", pos.alias("pos")), 9)


@query("a14_percentile_mean", """WITH q AS (SELECT ticker, quantile_cont(close_price, 0.9) AS p FROM px GROUP BY 1) SELECT ticker, ROUND(p, 6) AS p90, ROUND(AVG(close_price), 4) AS mean_above FROM px JOIN q USING (ticker) WHERE close_price >= p GROUP BY 1, p""")
def a14(t):
    q = ranking.exact_quantiles(t.px, ["ticker"], "close_price", {"p90": 0.9})
    out = t.px.join(q, "ticker").where(F.col("close_price") >= F.col("p90")).groupBy("ticker", "p90").agg(F.avg("close_price").alias("m"))
    return out.select("ticker", F.round("p90", 6).alias("p90"), F.round("m", 4).alias("mean_above"))


@query("a15_mode_day", "SELECT MIN(day) AS date FROM (SELECT day, COUNT(*) AS n FROM ev GROUP BY 1) WHERE n = (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM ev GROUP BY day))")
def a15(t):
    from tidespine.plans.scoring import partition_day

    return partition_day(t.raw("events"), "ts")


@query("a16_newest_per_source", "SELECT 'orders' AS source, MAX(CAST(o_orderdate AS DATE)) AS latest FROM orders UNION ALL SELECT 'lineitem', MAX(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'events', MAX(CAST(ts AS DATE)) FROM events")
def a16(t):
    one = lambda n, c: t.raw(n).agg(F.max(F.to_date(c)).alias("latest")).select(F.lit(n).alias("source"), "latest")
    return one("orders", "o_orderdate").unionByName(one("lineitem", "l_shipdate")).unionByName(one("events", "ts"))


@query("a17_sign_agreement", "SELECT ticker, ROUND(AVG((sign(predicted) = sign(actual))::INTEGER), 9) AS hit FROM panel GROUP BY 1")
def a17(t):
    return rounded(t.panel.groupBy("ticker").agg(hit_rate("predicted", "actual").alias("hit")), 9)


@query("a18_t_statistic", "SELECT layer, ROUND(AVG(actual), 6) AS mean, ROUND(STDDEV_SAMP(actual), 6) AS sd, ROUND(AVG(actual) / (STDDEV_SAMP(actual) / sqrt(COUNT(*))), 4) AS t FROM panel GROUP BY 1")
def a18(t):
    m, s = F.avg("actual"), F.stddev_samp("actual")
    return t.panel.groupBy("layer").agg(F.round(m, 6).alias("mean"), F.round(s, 6).alias("sd"), F.round(m / (s / F.sqrt(F.count("actual"))), 4).alias("t"))


@query("a19_peer_mean", """SELECT a.ticker, a.date, ROUND(CASE WHEN COUNT(b.ticker) >= 2 THEN AVG(b.short_vol_ratio) END, 12) AS peers FROM (SELECT si.*, layer FROM si JOIN nat USING (ticker)) a
 LEFT JOIN (SELECT si.*, layer FROM si JOIN nat USING (ticker)) b ON a.layer = b.layer AND a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2""")
def a19(t):
    out = mk.layer_momentum(t.si, t.si, t.layers, "short_vol_ratio", 2, 5)
    return rounded(out.select("ticker", "date", F.col("own_layer_momentum_20d").alias("peers")), 12)


@query("a20_profile", "SELECT COUNT(*) AS n, COUNT(DISTINCT ticker) AS tickers, MIN(date) AS first_day, MAX(date) AS last_day FROM px")
def a20(t):
    return t.px.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


# ---- windows ---------------------------------------------------------------------------------------


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


@query("w01_lag_returns", "SELECT ticker, date, ROUND(return_1d, 9) AS r1, ROUND(return_5d, 9) AS r5, ROUND(return_20d, 9) AS r20 FROM pf")
def w01(t):
    r = lambda n: F.round(sc.change("close_price", F.lag("close_price", n).over(_by_ticker())), 9).alias(f"r{n}")
    return t.px.select("ticker", "date", r(1), r(5), r(20))


@query("w02_mean_deviation", "SELECT ticker, date, ROUND(sma_20_deviation, 9) AS dev FROM pf")
def w02(t):
    return t.px.select("ticker", "date", F.round(sc.change("close_price", F.avg("close_price").over(trailing("ticker", "date", 20))), 9).alias("dev"))


@query("w03_dispersion", "SELECT ticker, date, ROUND(volatility_20d, 9) AS vol FROM pf")
def w03(t):
    w = trailing("ticker", "date", 20)
    return t.px.select("ticker", "date", F.round(sc.ratio(F.stddev_samp("close_price").over(w), F.avg("close_price").over(w)), 9).alias("vol"))


@query("w04_volume_ratio", "SELECT ticker, date, ROUND(volume_ratio, 9) AS ratio FROM pf")
def w04(t):
    return t.px.select("ticker", "date", F.round(sc.ratio("volume", F.avg(F.col("volume").cast("double")).over(trailing("ticker", "date", 20))), 9).alias("ratio"))


@query("w05_lead_252", "SELECT ticker, date, LEAD(close_price, 252) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM px QUALIFY ahead IS NOT NULL")
def w05(t):
    return t.px.select("ticker", "date", F.lead("close_price", 252).over(_by_ticker()).alias("ahead")).where("ahead is not null")


@query("w06_leads", "SELECT ticker, date, LEAD(close_price, 5) OVER w AS a5, LEAD(close_price, 65) OVER w AS a65, LEAD(close_price, 756) OVER w AS a756 FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def w06(t):
    return t.px.select("ticker", "date", *[F.lead("close_price", n).over(_by_ticker()).alias(f"a{n}") for n in (5, 65, 756)])


@query("w07_newest_rows", "SELECT ticker, quarter_end, eps_actual, CAST(row_number() OVER (PARTITION BY ticker ORDER BY quarter_end DESC) AS INTEGER) AS rn FROM er QUALIFY rn <= 4")
def w07(t):
    w = Window.partitionBy("ticker").orderBy(F.col("quarter_end").desc())
    return t.er.select("ticker", "quarter_end", "eps_actual", F.row_number().over(w).alias("rn")).where("rn <= 4")


@query("w08_newest_minus_previous", "SELECT ticker, ROUND(MAX(CASE WHEN rn = 1 THEN eps_actual END) - MAX(CASE WHEN rn = 2 THEN eps_actual END), 6) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end DESC) AS rn FROM er) GROUP BY 1")
def w08(t):
    w = Window.partitionBy("ticker").orderBy("quarter_end")
    rows = t.er.select("ticker", "quarter_end", (F.col("eps_actual") - F.lag("eps_actual").over(w)).alias("diff"))
    return rounded(rows.groupBy("ticker").agg(F.max_by("diff", "quarter_end").alias("diff")))


@query("w09_calendar_sum", "SELECT ticker, date, CAST(SUM(volume) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS v7, CAST(SUM(volume) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS v30 FROM px")
def w09(t):
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    return t.px.select("ticker", "date", F.sum("volume").over(w.rangeBetween(-6, 0)).alias("v7"), F.sum("volume").over(w.rangeBetween(-29, 0)).alias("v30"))


@query("w10_calendar_max", "SELECT ticker, date, MAX(close_price) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS peak FROM px")
def w10(t):
    w = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-29, 0)
    return t.px.select("ticker", "date", F.max("close_price").over(w).alias("peak"))


@query("w11_full_sum", "SELECT ticker, period_end, ROUND(CASE WHEN COUNT(rd_expense) OVER r = 4 THEN SUM(rd_expense) OVER r END, 2) AS ttm FROM fq WINDOW r AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING)")
def w11(t):
    return rounded(t.fq.select("ticker", "period_end", full_sum("rd_expense", "ticker", "period_end", 4).alias("ttm")), 2)


@query("w12_lag_of_sum", """SELECT ticker, period_end, ROUND(LAG(ttm, 4) OVER (PARTITION BY ticker ORDER BY period_end), 2) AS prior FROM (SELECT ticker, period_end, CASE WHEN COUNT(revenue) OVER r = 4 THEN SUM(revenue) OVER r END AS ttm FROM fq WINDOW r AS (PARTITION BY ticker ORDER BY period_end ROWS 3 PRECEDING))""")
def w12(t):
    x = t.fq.select("ticker", "period_end", full_sum("revenue", "ticker", "period_end", 4).alias("ttm"))
    return rounded(x.select("ticker", "period_end", F.lag("ttm", 4).over(Window.partitionBy("ticker").orderBy("period_end")).alias("prior")), 2)


@query("w13_lag_differences", "SELECT ticker, period_end, ROUND(revenue - LAG(revenue, 1) OVER w, 2) AS d1, ROUND(revenue - LAG(revenue, 2) OVER w, 2) AS d2 FROM fq WINDOW w AS (PARTITION BY ticker ORDER BY period_end)")
def w13(t):
    w = Window.partitionBy("ticker").orderBy("period_end")
    return rounded(t.fq.select("ticker", "period_end", *[(F.col("revenue") - F.lag("revenue", n).over(w)).alias(f"d{n}") for n in (1, 2)]), 2)


@query("w14_daily_momentum", "SELECT date, n, n - LAG(n, 7) OVER (ORDER BY date) AS d7, n - LAG(n, 30) OVER (ORDER BY date) AS d30 FROM (SELECT day AS date, COUNT(*) AS n FROM ord GROUP BY 1)")
def w14(t):
    daily = t.ord.groupBy(F.col("day").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return daily.select("date", "n", *[(F.col("n") - F.lag("n", k).over(w)).alias(f"d{k}") for k in (7, 30)])


@query("w15_rolling_correlation", """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM si)), x AS (SELECT ticker, idx, short_vol_ratio AS v FROM si JOIN cal USING (date)),
 p AS (SELECT a.ticker, pr.peer, a.idx, a.v AS x, b.v AS y FROM x a JOIN peers pr ON pr.ticker = a.ticker LEFT JOIN x b ON b.ticker = pr.peer AND b.idx = a.idx),
 w AS (SELECT ticker, peer, idx, COUNT(y) OVER r AS n, covar_pop(CASE WHEN y IS NOT NULL THEN x END, y) OVER r AS cv, var_pop(CASE WHEN y IS NOT NULL THEN x END) OVER r AS vx, var_pop(y) OVER r AS vy FROM p WINDOW r AS (PARTITION BY ticker, peer ORDER BY idx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
 SELECT ticker, peer, CAST(idx AS INTEGER) AS idx, n AS overlap, ROUND(CASE WHEN n >= 30 AND vx > 1e-18 AND vy > 1e-18 THEN cv / sqrt(vx * vy) END, 5) AS corr FROM w""")
def w15(t):
    pairs = t.peers
    x = with_calendar(t.si).select("ticker", "idx", "short_vol_ratio")
    return rounded(rolling_correlation(x, pairs, "short_vol_ratio", 60, 30), 5)


_CAL = """cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM px)), pi AS (SELECT ticker, date, idx, close_price FROM px JOIN cal USING (date))"""


@query("w16_calendar_lag", f"WITH {_CAL} SELECT a.ticker, a.date, b.close_price AS back FROM pi a LEFT JOIN pi b ON a.ticker = b.ticker AND b.idx = a.idx - 20")
def w16(t):
    return calendar_lag(with_calendar(t.px), "close_price", 20, "back").select("ticker", "date", "back")


@query("w17_filled_change", f"""WITH {_CAL}, s AS (SELECT ticker, MIN(idx) AS a FROM pi GROUP BY 1), g AS (SELECT s.ticker, c.idx, c.date FROM s JOIN cal c ON c.idx >= s.a),
 f AS (SELECT g.ticker, g.idx, g.date, close_price FROM g ASOF JOIN pi ON g.ticker = pi.ticker AND g.idx >= pi.idx)
 SELECT ticker, date, ROUND(close_price / NULLIF(LAG(close_price) OVER (PARTITION BY ticker ORDER BY idx), 0) - 1, 9) AS ret FROM f""")
def w17(t):
    cal = calendar_index(t.px)
    return rounded(calendar_change(fill_gaps(t.px.select("ticker", "date", "close_price"), cal, "close_price"), "close_price", 1, "ret").select("ticker", "date", "ret"), 9)


@query("w18_streak", """SELECT ticker, quarter_end, CAST(rn - COALESCE(MAX(CASE WHEN eps_surprise IS NULL OR eps_surprise <= 0 THEN rn END) OVER (PARTITION BY ticker ORDER BY rn), 0) AS INTEGER) AS streak
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end) AS rn FROM er)""")
def w18(t):
    return streak(t.er, "eps_surprise", "ticker", "quarter_end", "streak").select("ticker", "quarter_end", "streak")


@query("w19_rank_position", """SELECT ticker, date, ROUND(CASE WHEN COUNT(close_price) OVER e < 30 OR MAX(close_price) OVER w <= MIN(close_price) OVER w THEN 50.0
 ELSE greatest(0.0, least(100.0, (close_price - MIN(close_price) OVER w) / NULLIF(MAX(close_price) OVER w - MIN(close_price) OVER w, 0) * 100)) END, 6) AS pos FROM px
 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING), e AS (PARTITION BY ticker ORDER BY date)""")
def w19(t):
    return rounded(rank_position(t.px, "close_price", "ticker", "date", 252, 30, "pos").select("ticker", "date", "pos"))


@query("w20_realised_volatility", """WITH r AS (SELECT ticker, date, CASE WHEN LAG(close_price) OVER w > 0 THEN ln(close_price / LAG(close_price) OVER w) END AS lr FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, ROUND(CASE WHEN COUNT(lr) OVER w >= 2 THEN STDDEV_SAMP(lr) OVER w * sqrt(252.0) END, 6) AS hv FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)""")
def w20(t):
    return rounded(realised_volatility(t.px, "close_price", "ticker", "date", "hv").select("ticker", "date", "hv"))


@query("w21_span_return", """SELECT ticker, date, ROUND(CASE WHEN COUNT(*) OVER w >= 2 THEN LAST_VALUE(close_price) OVER w / NULLIF(FIRST_VALUE(close_price) OVER w, 0) - 1 END, 9) AS r FROM px
 WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""")
def w21(t):
    return rounded(span_return(t.px, "close_price", "ticker", "date", 30, "r").select("ticker", "date", "r"), 9)


@query("w22_rank_all", "SELECT date, horizon, ticker, expected_annual_return, CAST(row_number() OVER (PARTITION BY date, horizon ORDER BY expected_annual_return DESC NULLS LAST, ticker) AS INTEGER) AS rank FROM preds")
def w22(t):
    from tidespine.plans.evaluate import rank_predictions

    return rank_predictions(t.preds, ["date", "horizon"]).select("date", "horizon", "ticker", "expected_annual_return", "rank")


@query("w23_full_mean", "SELECT ticker, date, ROUND(CASE WHEN COUNT(close_price) OVER w = 20 THEN AVG(close_price) OVER w END, 6) AS sma FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)")
def w23(t):
    return rounded(t.px.select("ticker", "date", full_mean("close_price", "ticker", "date", 20).alias("sma")))


@query("w24_snapshot_lag", "SELECT hs_code, partner_code, direction, year, month, value_usd, LAG(value_usd) OVER (PARTITION BY direction, hs_code, partner_code ORDER BY year, month) AS prior FROM trade1")
def w24(t):
    rows = dedup.keep_latest(t.trade, ["direction", "hs_code", "partner_code", "year", "month"], ["date"]).drop("date")
    return rows.withColumn("prior", F.lag("value_usd").over(Window.partitionBy("direction", "hs_code", "partner_code").orderBy("year", "month")))


# ---- top-k, sets, reshape --------------------------------------------------------------------------


@query("t01_sort", "SELECT ticker, date, close_price FROM px ORDER BY date, ticker")
def t01(t):
    return t.px.select("ticker", "date", "close_price").orderBy("date", "ticker")


@query("t02_limit", "SELECT ticker, date, close_price FROM px ORDER BY close_price DESC, ticker, date LIMIT 50")
def t02(t):
    return t.px.select("ticker", "date", "close_price").orderBy(F.col("close_price").desc(), "ticker", "date").limit(50)


@query("t03_top_filers", """WITH i AS (SELECT DISTINCT o_custkey AS cik FROM orders), p AS (SELECT cik, SUM(shares_held) AS v FROM hold WHERE quarter = '1998Q2' GROUP BY 1)
 SELECT lpad(i.cik::VARCHAR, 10, '0') AS cik, CAST(v AS BIGINT) AS total_value FROM i LEFT JOIN p USING (cik) ORDER BY v DESC NULLS LAST, i.cik LIMIT 500""")
def t03(t):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    index = t.raw("orders").select(pad("o_custkey").alias("cik"))
    prior = t.hold.where("quarter = '1998Q2'").select(pad("cik").alias("cik"), F.col("shares_held").alias("value_usd_thousands"))
    return sf.top_filers(index, prior, 500)


@query("t04_nearest_expiry", """SELECT ticker, date, arg_min(expiry, abs(dte - 90) * 10000 + dte) AS expiry FROM (SELECT DISTINCT ticker, date, expiry, expiry - date AS dte FROM options) WHERE dte > 0 AND dte <= 100 GROUP BY 1, 2""")
def t04(t):
    return mk.nearest_expiry(t.options, 90, 100)


@query("t05_nth_row_ahead", """SELECT p.ticker, p.date, p.horizon, exit_date, ROUND(o / i - 1, 9) AS realized FROM preds p JOIN (
 SELECT ticker, date, close_price AS i, '5d' AS horizon, LEAD(close_price, 5) OVER w AS o, LEAD(date, 5) OVER w AS exit_date FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)
 UNION ALL SELECT ticker, date, close_price, '20d', LEAD(close_price, 20) OVER w, LEAD(date, 20) OVER w FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)) x USING (ticker, date, horizon) WHERE i > 0 AND o IS NOT NULL""")
def t05(t):
    from tidespine.plans.evaluate import realised

    return rounded(realised(t.preds, t.px).select("ticker", "date", "horizon", "exit_date", "realized"), 9)


@query("t06_top_ranked", "SELECT date, horizon, ticker FROM preds QUALIFY row_number() OVER (PARTITION BY date, horizon ORDER BY expected_annual_return DESC NULLS LAST, ticker) <= 3")
def t06(t):
    w = Window.partitionBy("date", "horizon").orderBy(F.col("expected_annual_return").desc_nulls_last(), "ticker")
    return t.preds.select("date", "horizon", "ticker", F.row_number().over(w).alias("rank")).where("rank <= 3").drop("rank")


@query("t07_top_decile", """SELECT ticker, ROUND(AVG(actual) FILTER (rn <= greatest(1, n // 10)), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY predicted DESC, date) AS rn, COUNT(*) OVER (PARTITION BY ticker) AS n FROM panel) GROUP BY 1""")
def t07(t):
    r = ranking.row_number_in_group(t.panel, ["ticker"], [F.col("predicted").desc(), F.col("date")], "rn", "n")
    top = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return rounded(r.groupBy("ticker").agg(F.avg(F.when(top, F.col("actual"))).alias("top_mean")))


@query("u01_union_all", "SELECT ticker, transaction_date AS date, 'insider' AS kind FROM tr UNION ALL SELECT ticker, trade_date, 'congress' FROM cg")
def u01(t):
    return t.tr.select("ticker", F.col("transaction_date").alias("date"), F.lit("insider").alias("kind")).unionByName(
        t.cg.select("ticker", F.col("trade_date").alias("date"), F.lit("congress").alias("kind")))


@query("u02_diagonal_union", "SELECT ticker, date, close_price, NULL::DOUBLE AS short_vol_ratio FROM px UNION ALL SELECT ticker, date, NULL, short_vol_ratio FROM si")
def u02(t):
    return dedup.diagonal_union(t.px.select("ticker", "date", "close_price"), t.si)


@query("u03_keep_latest", "SELECT direction, hs_code, partner_code, year, month, value_usd FROM trade1")
def u03(t):
    return dedup.keep_latest(t.trade, ["direction", "hs_code", "partner_code", "year", "month"], ["date"]).drop("date")


@query("u04_distinct", "SELECT DISTINCT ticker, date FROM px")
def u04(t):
    return spine_of(t.px)


@query("u05_key_intersection", "SELECT DISTINCT px.ticker, px.date FROM px JOIN cg ON cg.ticker = px.ticker AND cg.trade_date = px.date JOIN si ON si.ticker = px.ticker AND si.date = px.date")
def u05(t):
    return spine_of(t.px).join(t.cg.select("ticker", F.col("trade_date").alias("date")).distinct(), ["ticker", "date"]).join(t.si.select("ticker", "date"), ["ticker", "date"])


@query("u06_symmetrise", "SELECT a AS x, b AS y, n FROM (SELECT party_a AS a, party_b AS b, COUNT(*) AS n FROM deals GROUP BY 1, 2) UNION ALL SELECT b, a, n FROM (SELECT party_a AS a, party_b AS b, COUNT(*) AS n FROM deals GROUP BY 1, 2)")
def u06(t):
    e = t.deals.groupBy(F.col("party_a").alias("x"), F.col("party_b").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return dedup.symmetrise(e, "x", "y")


@query("u07_pivot", """SELECT date, ROUND(COALESCE(SUM(value) FILTER (metric = 'cve_critical'), 0), 6) AS cve_critical, ROUND(COALESCE(SUM(value) FILTER (metric = 'cve_high'), 0), 6) AS cve_high, 0.0::DOUBLE AS unseen FROM threats GROUP BY 1""")
def u07(t):
    return rounded(dedup.pivot_sum(t.threats, ["date"], "metric", "value", ["cve_critical", "cve_high", "unseen"]))


@query("u08_unpivot", "SELECT ticker, period_end, name, value FROM (UNPIVOT (SELECT ticker, period_end, revenue, capex, equity FROM fq) ON revenue, capex, equity INTO NAME name VALUE value)")
def u08(t):
    return t.fq.select("ticker", "period_end", "revenue", "capex", "equity").unpivot(["ticker", "period_end"], ["revenue", "capex", "equity"], "name", "value")


@query("u09_amendments", """SELECT ticker, concept, "end", val, filed FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, "end" ORDER BY filed DESC, "start" DESC, val DESC) AS rn FROM facts) WHERE rn = 1""")
def u09(t):
    return fl.latest_filed(t.facts).select("ticker", "concept", "end", "val", "filed")


# ---- graph -----------------------------------------------------------------------------------------


@query("f09_hops", """WITH RECURSIVE e AS (SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS ticker FROM u),
 bfs(node, h) AS (SELECT 'S1', 0 UNION SELECT u.b, h + 1 FROM bfs JOIN u ON u.a = bfs.node WHERE h < 12)
 SELECT n.ticker, CAST(MIN(h) AS INTEGER) AS hops, ROUND(COALESCE(1.0::DOUBLE / (MIN(h) + 1), 0.0), 9) AS proximity FROM n LEFT JOIN bfs ON node = n.ticker GROUP BY 1""")
def f09_hops(t):
    o = t.raw("orders").select("o_orderkey", "o_custkey")
    l = t.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = cut_lineage(l.select("o_custkey", "l_suppkey").distinct())
    e = dedup.symmetrise(pairs.select(F.concat(F.lit("C"), "o_custkey").alias("x"), F.concat(F.lit("S"), "l_suppkey").alias("y")), "x", "y")
    out = hops_to_set(e.select(F.col("x").alias("ticker")), e, ["S1"], a="x", b="y", both_ways=True)
    return out.select("ticker", "hops", F.round(proximity("hops"), 9).alias("proximity"))


@query("f09b_deals", f"""WITH {_TEXT_DEALS}, m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date, party_a, party_b, deal_type FROM deals),
 a AS (SELECT date, party_a, party_b, deal_type, NULL AS description, 'manual' AS source, NULL AS source_url, 1.0::DOUBLE AS confidence, NULL::DOUBLE AS deal_mw, 'other' AS buyer_type FROM m
 UNION ALL SELECT date, party_a, party_b, deal_type, description, source, source_url, confidence, deal_mw, buyer_type FROM td)
 SELECT a.*, x.layer AS layer_a, y.layer AS layer_b, party_a || '-' || party_b || '-' || a.date::VARCHAR AS deal_id FROM a LEFT JOIN nat x ON x.ticker = party_a LEFT JOIN nat y ON y.ticker = party_b""")
def f09b(t):
    manual = t.deals.select(F.trunc("date", "month").alias("date"), "party_a", "party_b", "deal_type").distinct()
    return dl.build_deals(manual, dl.text_deals(t.filing, t.companies), t.layers)


@query("f09b_edges", f"""WITH {_TEXT_DEALS}, e0 AS (SELECT least(party_a, party_b) AS a, greatest(party_a, party_b) AS b, SUM(confidence * power(0.5, (DATE '2024-06-30' - date) / 365.25)) AS w, COUNT(*) AS n,
 MAX(date) AS l, array_to_string(list_sort(list_distinct(array_agg(deal_type))), '|') AS ty FROM td GROUP BY 1, 2)
 SELECT a AS ticker_from, b AS ticker_to, ROUND(w, 6) AS edge_weight, CAST(n AS INTEGER) AS deal_count, l AS last_deal_date, ty AS edge_types FROM e0 UNION ALL SELECT b, a, ROUND(w, 6), CAST(n AS INTEGER), l, ty FROM e0""")
def f09b_edges(t):
    return rounded(dl.build_edges(dl.text_deals(t.filing, t.companies), "2024-06-30"))
