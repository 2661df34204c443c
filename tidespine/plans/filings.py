"""Families fed by periodic company reports: fundamentals, earnings surprises, holdings, capex totals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.functions.scalar import change, ratio, yoy
from tidespine.operators.asof import asof_join
from tidespine.operators.dedup import keep_latest
from tidespine.operators.windows import full_sum, streak
from tidespine.schemas import FUNDAMENTAL_COLS

EARNINGS_COLS = ["eps_surprise_last", "eps_surprise_mean_4q", "eps_beat_streak"]
OWNERSHIP_COLS = ["inst_ownership_pct", "inst_net_shares_qoq", "inst_holder_count",
                  "inst_concentration_top10", "inst_momentum_2q"]
AI_ECONOMICS_COLS = ["ai_capex_coverage_ratio", "hyperscaler_capex_aggregate", "hyperscaler_capex_yoy"]

# Reporting concepts tried in order, the first one with any rows wins.
CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
                "RevenueFromContractWithCustomerIncludingAssessedTax"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
    "rd_expense": ["ResearchAndDevelopmentExpense"],
    "equity": ["StockholdersEquity", "StockholdersEquityAttributableToParent"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "shares_outstanding": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
}
FLOWS = ["revenue", "gross_profit", "operating_income", "net_income", "capex", "rd_expense"]
BALANCES = ["equity", "long_term_debt", "current_assets", "current_liabilities", "shares_outstanding"]
REPORT_FORMS = ["10-K", "10-Q", "20-F"]
QUARTER_DAYS = (75, 105)
YEAR_DAYS = (350, 380)


def attach_fundamentals(spine: DataFrame, fundamentals: DataFrame, lag_days: int = 0,
                        cols: list[str] = FUNDAMENTAL_COLS) -> DataFrame:
    """Newest quarter with period_end (+ reporting lag) on or before each spine day."""
    return asof_join(spine, fundamentals, on="date", right_on="period_end", by=["ticker"],
                     cols=cols, lag_days=lag_days)


def first_concept(facts: DataFrame, priority: DataFrame) -> DataFrame:
    """Keep, per (ticker, measure), the facts of the first concept that has any rows.

    ``priority`` is (measure, concept, rank), a small fixed table.
    """
    ranked = facts.join(F.broadcast(priority), "concept")
    best = ranked.groupBy("ticker", "measure").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["ticker", "measure", "rank"], "left_semi")


def period_facts(facts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Facts whose period lasts lo..hi days; of several filings for one period end, the latest filed."""
    days = F.date_diff("end", "start")
    kept = facts.where(F.col("start").isNotNull() & days.between(lo, hi))
    return latest_filed(kept)


def latest_filed(facts: DataFrame) -> DataFrame:
    keys = [c for c in ("ticker", "measure", "concept", "end") if c in facts.columns]
    return keep_latest(facts, keys, ["filed"])


def statements(facts: DataFrame, annual_filers: list[str] = ()) -> DataFrame:
    """Raw facts to one row per (ticker, period_end) with income, cash and balance columns.

    Rows exist where revenue exists; capital spending is stored positive.
    """
    spark = facts.sparkSession
    priority = spark.createDataFrame(
        [(m, c, i) for m, cs in CONCEPTS.items() for i, c in enumerate(cs)], "measure string, concept string, rank int")
    facts = facts.where(F.col("form").isin(REPORT_FORMS))
    chosen = first_concept(facts, priority)
    flows = chosen.where(F.col("measure").isin(FLOWS))
    days = F.date_diff("end", "start")
    annual = F.col("ticker").isin(list(annual_filers))
    fits = F.when(annual, days.between(*YEAR_DAYS)).otherwise(days.between(*QUARTER_DAYS))
    kept = flows.where(F.col("start").isNotNull() & fits).unionByName(chosen.where(F.col("measure").isin(BALANCES)))
    best = keep_latest(kept.select("ticker", "measure", "end", "filed", "val"), ["ticker", "measure", "end"], ["filed"])
    wide = best.groupBy("ticker", F.col("end").alias("period_end")).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("val"))).alias(m) for m in FLOWS + BALANCES])
    # Balance items other than equity are only read on dates that carry an equity fact.
    return wide.where(F.col("revenue").isNotNull()).select(
        "ticker", "period_end", *[F.abs(m).alias(m) if m == "capex" else m for m in FLOWS], "equity",
        *[F.when(F.col("equity").isNotNull(), F.col(m)).alias(m) for m in BALANCES[1:]])


def _positive(x: str) -> Column:
    return F.when(F.col(x) > 0, F.col(x))


def derive_ratios(wide: DataFrame) -> DataFrame:
    """Margins, leverage, calendar-aware growth and trailing-four-quarter ratios per (ticker, period_end)."""
    wide = wide.withColumns({"_y": F.year("period_end"), "_q": F.quarter("period_end")})
    prior = keep_latest(wide.select("ticker", "_y", "_q", "period_end", "revenue"), ["ticker", "_y", "_q"], ["period_end"])
    prior = prior.select("ticker", (F.col("_y") + 1).alias("_y"), "_q", F.col("revenue").alias("_rev_prior"))
    df = wide.join(prior, ["ticker", "_y", "_q"], "left").drop("_y", "_q")
    w = Window.partitionBy("ticker").orderBy("period_end")
    df = df.withColumns({
        "revenue_growth_yoy": ratio(F.col("revenue") - F.col("_rev_prior"), _positive("_rev_prior")),
        "gross_margin": ratio("gross_profit", "revenue"),
        "operating_margin": ratio("operating_income", "revenue"),
        "capex_to_revenue": ratio("capex", "revenue"),
        "debt_to_equity": ratio("long_term_debt", _positive("equity")),
        "current_ratio": ratio("current_assets", _positive("current_liabilities")),
        "_rd": F.coalesce("rd_expense", F.lit(0.0)),
    })
    df = df.withColumns({f"_t_{c}": full_sum(c, "ticker", "period_end", 4)
                         for c in ("net_income", "operating_income", "capex", "revenue", "_rd")})
    df = df.withColumns({"_t_capex_prior": F.lag("_t_capex", 4).over(w),
                         "_yoy_prior": F.lag("revenue_growth_yoy", 1).over(w)})
    zero = F.lit(0.0)
    df = df.withColumns({
        "net_income_margin": F.coalesce(ratio("_t_net_income", "_t_revenue"), zero),
        "free_cash_flow_margin": F.coalesce(
            ratio(F.col("_t_operating_income") - F.col("_t_capex"), "_t_revenue"), zero),
        "capex_growth_yoy": change("_t_capex", _positive("_t_capex_prior")),
        "revenue_growth_accel": F.coalesce(F.col("revenue_growth_yoy") - F.col("_yoy_prior"), zero),
        "research_to_revenue": F.coalesce(ratio("_t__rd", "_t_revenue"), zero),
    })
    return df.drop("_rev_prior", "_rd", "_t_net_income", "_t_operating_income", "_t_capex", "_t_revenue",
                   "_t__rd", "_t_capex_prior", "_yoy_prior")


def valuation(wide: DataFrame, prices: DataFrame) -> DataFrame:
    """Price multiples at each period end from the latest close; null when the denominator is not positive."""
    priced = asof_join(wide, prices.select("ticker", "date", "close_price"), on="period_end", right_on="date",
                       by=["ticker"])
    cap = F.col("close_price") * F.col("shares_outstanding")
    ttm = {c: full_sum(c, "ticker", "period_end", 4) for c in ("revenue", "net_income")}
    priced = priced.withColumns({"_cap": cap, "_ni": ttm["net_income"], "_rev": ttm["revenue"]})
    return priced.withColumns({
        "pe_ratio_trailing": ratio("_cap", _positive("_ni")),
        "price_to_sales": ratio("_cap", _positive("_rev")),
        "price_to_book": ratio("_cap", _positive("equity")),
    }).drop("close_price", "_cap", "_ni", "_rev")


def fundamentals_from_facts(facts: DataFrame, prices: DataFrame, annual_filers: list[str] = ()) -> DataFrame:
    """Raw reported facts to the fundamentals table."""
    return valuation(derive_ratios(statements(facts, annual_filers)), prices).select(
        "ticker", "period_end", *FUNDAMENTAL_COLS)


def statement_quarters(quarters: DataFrame) -> DataFrame:
    """Margins and growth against the row four quarters back; multiples only on the newest row.

    Expects (ticker, period_end, revenue, gross_profit, operating_income, capex, total_debt, equity,
    current_assets, current_liabilities) plus market multiples (pe, ps, pb) that describe today.
    """
    w = Window.partitionBy("ticker").orderBy("period_end")
    prior = F.lag("revenue", 4).over(w)
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("period_end").desc())) == 1
    return quarters.withColumns({
        "revenue_growth_yoy": ratio(F.col("revenue") - prior, F.abs(prior)),
        "gross_margin": ratio("gross_profit", "revenue"),
        "operating_margin": ratio("operating_income", "revenue"),
        "capex_to_revenue": ratio(F.abs("capex"), "revenue"),
        "debt_to_equity": ratio("total_debt", _positive("equity")),
        "current_ratio": ratio("current_assets", "current_liabilities"),
        "pe_ratio_trailing": F.when(newest, F.col("pe")),
        "price_to_sales": F.when(newest, F.col("ps")),
        "price_to_book": F.when(newest, F.col("pb")),
    })


def earnings_states(earnings: DataFrame, max_len: int | None = None) -> DataFrame:
    """What is known right after each reported quarter: last surprise, mean of the last four non-null, streak."""
    rows = keep_latest(earnings.select("ticker", "quarter_end", "eps_surprise", "eps_surprise_pct"),
                       ["ticker", "quarter_end"], ["eps_surprise", "eps_surprise_pct"])
    rows = streak(rows, "eps_surprise", "ticker", "quarter_end", "eps_beat_streak", max_len)
    seen = F.count("eps_surprise_pct").over(
        Window.partitionBy("ticker").orderBy("quarter_end").rowsBetween(Window.unboundedPreceding, 0))
    last4 = Window.partitionBy("ticker").orderBy("_seen").rangeBetween(-3, 0)
    rows = rows.withColumn("_seen", seen)
    return rows.select("ticker", "quarter_end", F.col("eps_surprise_pct").alias("eps_surprise_last"),
                       F.avg("eps_surprise_pct").over(last4).alias("eps_surprise_mean_4q"), "eps_beat_streak")


def attach_earnings(spine: DataFrame, earnings: DataFrame, lag_days: int = 0) -> DataFrame:
    """Earnings state as of each day; the streak is 0 for a ticker without reports."""
    out = asof_join(spine, earnings_states(earnings), on="date", right_on="quarter_end", by=["ticker"],
                    cols=EARNINGS_COLS, lag_days=lag_days)
    return out.withColumn("eps_beat_streak", F.coalesce(F.col("eps_beat_streak"), F.lit(0)))


def surprises(reports: DataFrame) -> DataFrame:
    """Actual vs estimate; the percentage is null when the estimate is practically zero."""
    diff = F.col("eps_actual") - F.col("eps_estimate")
    base = F.abs("eps_estimate")
    return reports.withColumns({"eps_surprise": diff, "eps_surprise_pct": F.when(base > 1e-9, diff / base)})


def ownership_features(holdings: DataFrame, shares: DataFrame) -> DataFrame:
    """Per (ticker, quarter): held share of the company, quarterly change, holders, top-ten share, momentum.

    The top ten rows come from a row_number filter, which Spark limits inside each map task first.
    """
    key = ["ticker", "quarter", "period_end"]
    totals = holdings.groupBy(*key).agg(F.sum("shares_held").alias("_total"),
                                        F.count_distinct("cik").alias("inst_holder_count"))
    big = Window.partitionBy("ticker", "quarter").orderBy(F.col("shares_held").desc())
    top = (holdings.select("ticker", "quarter", "shares_held").withColumn("_r", F.row_number().over(big))
           .where("_r <= 10").groupBy("ticker", "quarter").agg(F.sum("shares_held").alias("_top")))
    df = totals.join(top, ["ticker", "quarter"], "left").join(shares, "ticker", "left")
    w = Window.partitionBy("ticker").orderBy("period_end")
    out = _positive("shares_outstanding")
    df = df.withColumns({
        "inst_ownership_pct": ratio("_total", out) * 100.0,
        "inst_concentration_top10": ratio("_top", _positive("_total")),
        "inst_net_shares_qoq": ratio(F.col("_total") - F.lag("_total", 1).over(w), out),
    })
    df = df.withColumn("inst_momentum_2q", F.col("inst_ownership_pct") - F.lag("inst_ownership_pct", 2).over(w))
    return df.select(*key, "inst_ownership_pct", "inst_net_shares_qoq",
                     F.col("inst_holder_count").cast("int").alias("inst_holder_count"),
                     "inst_concentration_top10", "inst_momentum_2q")


def attach_ownership(spine: DataFrame, features: DataFrame, lag_days: int = 0) -> DataFrame:
    return asof_join(spine, features, on="date", right_on="period_end", by=["ticker"], cols=OWNERSHIP_COLS,
                     lag_days=lag_days)


def trailing_totals(quarters: DataFrame, days: DataFrame, window_days: int = 400) -> DataFrame:
    """(date, revenue, capex): sum over companies of their four newest quarters inside the window.

    Null when any company with a quarter in the window has fewer than four. Each quarter row is active
    from its period end until the next one (or until it leaves the window), so it contributes one +step
    and one -step; running sums over days replace the company x day product. Decimals keep the
    add-and-subtract exact.
    """
    w = Window.partitionBy("ticker").orderBy("period_end")
    last4 = w.rowsBetween(-3, 0)
    money = "decimal(30,4)"
    q = quarters.select(
        "ticker", "period_end",
        F.lead("period_end").over(w).alias("_next"), F.lag("period_end", 3).over(w).alias("_oldest"),
        F.coalesce(F.sum(F.col("revenue").cast(money)).over(last4), F.lit(0)).cast(money).alias("_rev"),
        F.coalesce(F.sum(F.col("capex").cast(money)).over(last4), F.lit(0)).cast(money).alias("_capex"))
    zero = F.lit(0).cast(money)

    def steps(start, end, seen, full, rev, capex):
        one = [(start, 1), (end, -1)]
        return [F.struct(at.alias("_d"), (F.lit(seen) * s).alias("_seen"), (F.lit(full) * s).alias("_full"),
                         (rev * s).cast(money).alias("_rev"), (capex * s).cast(money).alias("_capex"))
                for at, s in one]

    gone = F.least(F.date_add("period_end", window_days + 1), F.col("_next"))
    stale = F.least(F.date_add("_oldest", window_days + 1), F.col("_next"))
    seen = q.select(F.explode(F.array(*steps(F.col("period_end"), gone, 1, 0, zero, zero))).alias("_e"))
    full = q.where((F.col("_oldest").isNotNull()) & (stale > F.col("period_end"))).select(
        F.explode(F.array(*steps(F.col("period_end"), stale, 0, 1, F.col("_rev"), F.col("_capex")))).alias("_e"))
    daily = seen.unionByName(full).select("_e.*").groupBy("_d").agg(
        *[F.sum(c).alias(c) for c in ("_seen", "_full", "_rev", "_capex")])
    want = days.select(F.col("date").alias("_d")).distinct().withColumn("_want", F.lit(True))
    rows = daily.unionByName(want, allowMissingColumns=True)
    run = Window.partitionBy(F.lit(0)).orderBy(F.unix_date("_d")).rangeBetween(Window.unboundedPreceding, 0)
    sums = {c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in ("_seen", "_full", "_rev", "_capex")}
    rows = rows.select("_d", "_want", *[e.alias(c) for c, e in sums.items()]).where("_want")
    whole = (F.col("_seen") > 0) & (F.col("_seen") == F.col("_full"))
    return rows.select(F.col("_d").alias("date"),
                       F.when(whole, F.col("_rev").cast("double")).alias("revenue"),
                       F.when(whole, F.col("_capex").cast("double")).alias("capex"))


def ai_economics_features(spine: DataFrame, quarters: DataFrame) -> DataFrame:
    """Per spine day: capex / revenue, capex in billions and its change against 365 days earlier."""
    days = spine.select("date").distinct()
    probe = days.unionByName(days.select(F.date_sub("date", 365).alias("date"))).distinct()
    totals = trailing_totals(quarters, probe)
    prior = totals.select(F.date_add("date", 365).alias("date"), F.col("capex").alias("_prior"))
    return days.join(totals, "date", "left").join(prior, "date", "left").select(
        "date", ratio("capex", _positive("revenue")).alias("ai_capex_coverage_ratio"),
        (F.col("capex") / 1e9).alias("hyperscaler_capex_aggregate"),
        yoy("capex", "_prior").alias("hyperscaler_capex_yoy"))
