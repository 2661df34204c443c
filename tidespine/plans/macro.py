"""Market-wide families: threats, awards and queues, patents, labour, trade, industrial series, energy."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.functions.dates import month_period, quarter_end
from tidespine.functions.scalar import clip, ratio, yoy, zero_fill
from tidespine.operators.asof import asof_join
from tidespine.operators.dedup import keep_latest, pivot_sum
from tidespine.operators.intervals import Span, span_agg
from tidespine.operators.match import CUTOFF, match_names

KEYS = ["ticker", "date"]
CYBER_COLS = ["cve_critical_7d", "cve_high_7d", "cisa_kev_7d", "otx_pulse_7d", "cve_critical_30d", "cisa_kev_30d",
              "cyber_threat_index_7d"]
GOV_TICKER_COLS = ["gov_contract_value_90d", "gov_contract_count_90d", "gov_contract_momentum"]
GOV_MARKET_COLS = ["gov_ai_spend_30d", "ferc_queue_mw_30d", "ferc_grid_constraint_score"]
PATENT_COLS = ["patent_app_count_90d", "patent_app_momentum", "patent_grant_count_365d", "patent_grant_rate_365d",
               "patent_ai_cpc_share_90d", "patent_citation_count_365d"]
LABOR_COLS = ["gov_ai_hiring_30d", "gov_ai_hiring_momentum", "tech_job_openings_index", "tech_job_openings_momentum"]
TRADE_COLS = ["semicon_import_value", "semicon_import_momentum", "dc_equipment_import_value",
              "dc_equipment_import_momentum", "china_semicon_export_share", "taiwan_semicon_import_share"]
ENERGY_COLS = ["us_power_moat_score", "geo_weighted_tailwind_score"]

# Fixed values.
THREAT_METRICS = ["cve_critical", "cve_high", "cisa_kev", "otx_pulse"]
AI_INDUSTRY_CODES = ["541511", "541512", "541519", "518210", "334413"]
DATA_CENTER_STATES = ["VA", "TX", "OH", "AZ", "NV", "OR", "GA", "WA"]
AI_PATENT_GROUP = "G06N"
OPENINGS_SERIES = "JTS510000000000000JOL"
MACHINERY_SERIES = "JTS333000000000000JOL"
SEMICONDUCTOR_CODES = ["8541", "8542"]
EQUIPMENT_CODES = ["8471", "8473"]
CHINA, TAIWAN, ALL_PARTNERS = "5700", "5830", "ALL"
POWER_TICKERS = ["CEG", "VST", "NRG", "TLN", "NEE", "SO", "EXC", "ETR", "GEV", "BWX", "OKLO", "SMR", "FSLR"]
REGION_COUNTRIES = {
    "north_america": ["United States", "Canada"],
    "emea": ["Germany", "United Kingdom", "France", "Netherlands"],
    "nordics": ["Norway", "Sweden", "Iceland"],
    "asia_pacific": ["Japan", "South Korea", "Singapore", "Malaysia"],
}


def cyber_features(threats: DataFrame, dense_days: DataFrame | None = None) -> DataFrame:
    """Rolling threat sums and an index in [0, 1], one row per day with events.

    The windows are half-open, (d-7, d] and (d-30, d]. ``dense_days`` adds quiet days as zero rows.
    """
    daily = pivot_sum(threats, ["date"], "metric", "value", THREAT_METRICS)
    if dense_days is not None:
        quiet = dense_days.select("date").distinct().join(daily.select("date"), "date", "left_anti")
        daily = daily.unionByName(quiet, allowMissingColumns=True).fillna(0.0)
    w = Window.partitionBy(F.lit(0)).orderBy(F.unix_date("date"))
    week, month = w.rangeBetween(-6, 0), w.rangeBetween(-29, 0)
    df = daily.withColumns({**{f"{m}_7d": F.sum(m).over(week) for m in THREAT_METRICS},
                            **{f"{m}_30d": F.sum(m).over(month) for m in ("cve_critical", "cisa_kev")}})
    df = df.withColumn("_w", F.col("cve_critical_7d") * 3 + F.col("cve_high_7d") + F.col("cisa_kev_7d") * 2)
    peak = F.greatest(F.max("_w").over(month), F.lit(1.0))
    return df.withColumn("cyber_threat_index_7d", clip(F.col("_w") / peak, 0.0, 1.0)).select("date", *CYBER_COLS)


def matched_names(rows: DataFrame, name: str, targets: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(name, ticker) for the names of filings that resemble a registered one: the name table of awards and patents where none is kept by hand.

    ``targets`` is (ticker, search_name). Every spelling at or above the cutoff counts, and goes to its best ticker.
    """
    found = match_names(rows.select(F.col(name).alias("raw")).where(F.col(name).isNotNull()), targets, cutoff, all_names=True)
    return found.withColumnRenamed("raw", name)


def gov_ticker_features(spine: DataFrame, awards: DataFrame, names: DataFrame, dedup: bool = False) -> DataFrame:
    """Award value, count and momentum per (ticker, date). ``names`` maps awardee_name to ticker.

    ``dedup`` counts a restated award once (latest snapshot per award).
    """
    if dedup:
        awards = latest_awards(awards)
    matched = awards.join(names.select("awardee_name", "ticker"), "awardee_name")
    value = F.col("contract_value_usd")
    s = span_agg(spine, matched, ["ticker"], "date", [
        Span("_v90", "sum", value, -90), Span("_n90", "count", None, -90), Span("_v30", "sum", value, -30)])
    v90, v30 = zero_fill(F.col("_v90").cast("double")), zero_fill(F.col("_v30").cast("double"))
    return s.select(*KEYS, v90.alias("gov_contract_value_90d"), F.col("_n90").cast("double").alias("gov_contract_count_90d"),
                    (2.0 * v30 - v90).alias("gov_contract_momentum"))


def latest_awards(awards: DataFrame) -> DataFrame:
    return keep_latest(awards, ["uei", "awardee_name", "contract_value_usd", "naics_code", "agency"], ["date"])


def gov_market_features(spine: DataFrame, awards: DataFrame, queue: DataFrame,
                        codes: list[str] = AI_INDUSTRY_CODES, states: list[str] = DATA_CENTER_STATES) -> DataFrame:
    """Sector spend and interconnection-queue pressure per spine day."""
    spend = span_agg(spine, awards.where(F.col("naics_code").isin(codes)), [], "date",
                     [Span("_spend", "sum", F.col("contract_value_usd"), -30)])
    projects = keep_latest(queue, ["project_name", "queue_date"], ["snapshot_date"])
    projects = projects.where(F.col("queue_date").isNotNull() & F.col("state").isin(states))
    mw = span_agg(spine, projects.select("queue_date", "mw"), [], "date", [
        Span("_mw30", "sum", F.col("mw"), -30), Span("_mw365", "sum", F.col("mw"), -365)], facts_on="queue_date")
    mw30, mw365 = zero_fill(F.col("_mw30").cast("double")), zero_fill(F.col("_mw365").cast("double"))
    return spend.join(mw, "date", "full").select(
        "date", zero_fill(F.col("_spend").cast("double")).alias("gov_ai_spend_30d"), mw30.alias("ferc_queue_mw_30d"),
        (mw30 / F.greatest(mw365 / 12.0, F.lit(1.0))).alias("ferc_grid_constraint_score"))


def patent_features(spine: DataFrame, apps: DataFrame, grants: DataFrame, names: DataFrame,
                    ai_group: str = AI_PATENT_GROUP) -> DataFrame:
    """Application and grant windows per (ticker, date); restated ids count once, newest snapshot first."""
    mapped = names.select("assignee_name", "ticker")
    apps = keep_latest(apps, ["app_id"], ["date"]).join(mapped, "assignee_name")
    grants = keep_latest(grants, ["patent_id"], ["date"]).join(mapped, "assignee_name")
    one = F.lit(1)
    a = span_agg(spine, apps.drop("date"), ["ticker"], "date", [
        Span("_a90", "count", one, -90), Span("_prior", "count", one, -180, -91), Span("_a365", "count", one, -365),
        Span("_ai90", "sum", F.when(F.col("cpc_group") == ai_group, 1).otherwise(0), -90)], facts_on="filing_date")
    g = span_agg(spine, grants.drop("date"), ["ticker"], "date", [
        Span("_g365", "count", one, -365),
        Span("_cites", "sum", F.col("forward_citation_count").cast("double"), -365)], facts_on="grant_date")
    at_least_one = lambda c: F.greatest(F.col(c).cast("double"), F.lit(1.0))
    return a.join(g, KEYS, "left").select(
        *KEYS, F.col("_a90").cast("double").alias("patent_app_count_90d"),
        (F.col("_a90") - F.col("_prior")).cast("double").alias("patent_app_momentum"),
        F.col("_g365").cast("double").alias("patent_grant_count_365d"),
        (F.col("_g365") / at_least_one("_a365")).alias("patent_grant_rate_365d"),
        (zero_fill(F.col("_ai90").cast("double")) / at_least_one("_a90")).alias("patent_ai_cpc_share_90d"),
        zero_fill("_cites").alias("patent_citation_count_365d"))


def patent_buckets(filings: DataFrame, bucket: Column) -> DataFrame:
    """(quarter_end, cpc_class, filing_count) for filings whose class falls in a bucket."""
    return (filings.select(quarter_end("filing_date").alias("quarter_end"), bucket.alias("cpc_class"))
            .where(F.col("cpc_class").isNotNull()).groupBy("quarter_end", "cpc_class")
            .agg(F.count(F.lit(1)).alias("filing_count")))


def labor_features(spine: DataFrame, postings: DataFrame, openings: DataFrame,
                   series: str = OPENINGS_SERIES) -> DataFrame:
    """Postings per 30 days and their momentum, newest monthly openings index and its monthly change."""
    jobs = keep_latest(postings, ["posting_id"], ["date"])
    hires = span_agg(spine, jobs.select("posted_date"), [], "date", [
        Span("_n30", "count", None, -30), Span("_prior", "count", None, -60, -31)], facts_on="posted_date")
    months = keep_latest(openings.where(F.col("series_id") == series), ["year", "period"], ["date"])
    months = months.select(month_period(F.col("year"), F.col("period")).alias("_m"), F.col("value").alias("_v"))
    level = latest_month(spine, months, "_m", {"_v": "tech_job_openings_index"}, {"_v": "tech_job_openings_momentum"})
    return hires.join(level, "date", "left").select(
        "date", F.col("_n30").cast("double").alias("gov_ai_hiring_30d"),
        (F.col("_n30") - F.col("_prior")).cast("double").alias("gov_ai_hiring_momentum"),
        *[zero_fill(c).alias(c) for c in LABOR_COLS[2:]])


def latest_month(spine: DataFrame, months: DataFrame, on: str, levels: dict[str, str],
                 changes: dict[str, str]) -> DataFrame:
    """Newest monthly row on or before each spine day, with the change against the row before it.

    The previous value is found by a lag on the small monthly table; one as-of then serves both.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(on)
    table = months.select(on, *[F.col(src).alias(out) for src, out in levels.items()],
                          *[F.coalesce(F.col(src) - F.lag(src).over(w), F.lit(0.0)).alias(out)
                            for src, out in changes.items()])
    return asof_join(spine.select("date").distinct(), table, on="date", right_on=on, left_unique=True)


def trade_features(spine: DataFrame, trade: DataFrame) -> DataFrame:
    """Newest monthly import values with their change, and partner shares, per spine day."""
    rows = keep_latest(trade, ["direction", "hs_code", "partner_code", "year", "month"], ["date"])

    def cell(direction, codes, partner):
        hit = (F.col("direction") == direction) & F.col("hs_code").isin(codes) & (F.col("partner_code") == partner)
        return F.sum(F.when(hit, F.col("value_usd")))

    def months_of(direction, codes, partner=None):
        hit = (F.col("direction") == direction) & F.col("hs_code").isin(codes)
        if partner:
            hit = hit & (F.col("partner_code") == partner)
        return rows.where(hit).groupBy(F.make_date("year", "month", F.lit(1)).alias("_m"))

    days = spine.select("date").distinct()
    chips = months_of("import", SEMICONDUCTOR_CODES, ALL_PARTNERS).agg((F.sum("value_usd") / 1e6).alias("_v"))
    gear = months_of("import", EQUIPMENT_CODES, ALL_PARTNERS).agg((F.sum("value_usd") / 1e6).alias("_v"))
    out = latest_month(days, chips, "_m", {"_v": TRADE_COLS[0]}, {"_v": TRADE_COLS[1]})
    out = out.join(latest_month(days, gear, "_m", {"_v": TRADE_COLS[2]}, {"_v": TRADE_COLS[3]}), "date", "left")
    for direction, partner, name in (("export", CHINA, TRADE_COLS[4]), ("import", TAIWAN, TRADE_COLS[5])):
        part = F.coalesce(cell(direction, SEMICONDUCTOR_CODES, partner), F.lit(0.0))
        total = F.coalesce(cell(direction, SEMICONDUCTOR_CODES, ALL_PARTNERS), F.lit(0.0))
        share = months_of(direction, SEMICONDUCTOR_CODES).agg((part / F.greatest(total, F.lit(1.0))).alias("_v"))
        out = out.join(latest_month(days, share, "_m", {"_v": name}, {}), "date", "left")
    return out.select("date", *[zero_fill(c).alias(c) for c in TRADE_COLS])


@dataclass(frozen=True)
class Series:
    """One monthly or quarterly series: its key, output columns and staleness limit."""

    key: str
    level: str
    change: str | None
    tolerance_days: int


PHYSICAL_SERIES = [
    Series("NEWORDER", "phys_ai_capgoods_orders_level", "phys_ai_capgoods_orders_yoy", 60),
    Series("CFNAI", "phys_ai_cfnai_level", None, 60),
    Series("IPG3331S", "phys_ai_machinery_prod_level", "phys_ai_machinery_prod_yoy", 60),
    Series("WPU114", "phys_ai_machinery_ppi_level", "phys_ai_machinery_ppi_yoy", 60),
    Series(MACHINERY_SERIES, "phys_ai_machinery_jobs_level", "phys_ai_machinery_jobs_yoy", 60),
    Series("B25J", "phys_ai_patents_manipulators_count", "phys_ai_patents_manipulators_yoy", 120),
    Series("B64", "phys_ai_patents_aerial_count", "phys_ai_patents_aerial_yoy", 120),
    Series("B60W", "phys_ai_patents_avs_count", "phys_ai_patents_avs_yoy", 120),
    Series("G05D1", "phys_ai_patents_motion_count", "phys_ai_patents_motion_yoy", 120),
    Series("G05B19", "phys_ai_patents_progcontrol_count", "phys_ai_patents_progcontrol_yoy", 120),
    Series("G06V", "phys_ai_patents_vision_count", "phys_ai_patents_vision_yoy", 120),
]


def series_columns(specs: list[Series]) -> list[str]:
    return [c for s in specs for c in (s.level, s.change) if c]


PHYSICAL_COLS = series_columns(PHYSICAL_SERIES)


def series_features(spine: DataFrame, observations: DataFrame, specs: list[Series]) -> DataFrame:
    """Level and year-over-year change of several series per spine day, in one keyed as-of pass.

    ``observations`` is long: (series_id, date, value). Each day probes every series at d and d-365.
    """
    keys = F.array(*[F.lit(s.key) for s in specs])
    days = spine.select("date").distinct()
    probe = days.select(F.explode(F.array("date", F.date_sub("date", 365))).alias("_q")).distinct()
    probe = probe.select(F.explode(keys).alias("series_id"), "_q")
    hit = asof_join(probe, observations.select("series_id", "date", F.col("value").cast("double").alias("_v")),
                    on="_q", right_on="date", by=["series_id"], left_unique=True, matched_on="_seen")
    limit = F.lit(0)
    for s in specs:
        limit = F.when(F.col("series_id") == s.key, s.tolerance_days).otherwise(limit)
    fresh = hit.where(F.date_diff("_q", "_seen") <= limit)
    wide = fresh.groupBy("_q").agg(*[F.max(F.when(F.col("series_id") == s.key, F.col("_v"))).alias(s.level) for s in specs])
    now = days.join(wide.withColumnRenamed("_q", "date"), "date", "left")
    changing = [s for s in specs if s.change]
    back = wide.select(F.date_add("_q", 365).alias("date"), *[F.col(s.level).alias(f"_p_{s.level}") for s in changing])
    now = now.join(back, "date", "left")
    return now.withColumns({s.change: yoy(s.level, f"_p_{s.level}") for s in changing}).select(
        "date", *series_columns(specs))


def physical_observations(macro: DataFrame, openings: DataFrame, buckets: DataFrame) -> DataFrame:
    """The three sources of the industrial family as one long table; openings keep the newest snapshot."""
    jobs = openings.where((F.col("series_id") == MACHINERY_SERIES) & F.col("period").startswith("M"))
    jobs = keep_latest(jobs, ["series_id", "year", "period"], ["date"]).select(
        "series_id", month_period(F.col("year"), F.col("period")).alias("date"), "value")
    counts = buckets.select(F.col("cpc_class").alias("series_id"), F.col("quarter_end").alias("date"),
                            F.col("filing_count").cast("double").alias("value"))
    return macro.select("series_id", "date", "value").unionByName(jobs).unionByName(counts)


def physical_features(spine: DataFrame, macro: DataFrame, openings: DataFrame, buckets: DataFrame) -> DataFrame:
    return series_features(spine, physical_observations(macro, openings, buckets), PHYSICAL_SERIES)


def power_moat(spine: DataFrame, zone_queue: DataFrame, capacity: DataFrame, zone: str = "ALL_VIRGINIA",
               fuels: tuple[str, ...] = ("nuclear", "natural_gas"), lookback_days: int = 1095) -> DataFrame:
    """Per spine day: queue backlog over base-load capacity, placed in its trailing range, in [0, 1]."""
    days = spine.select("date").distinct()
    queue = zone_queue.where(F.col("zone") == zone).select("date", "queue_backlog_gw")
    now = asof_join(days, queue.withColumnRenamed("date", "_d"), on="date", right_on="_d", left_unique=True)
    fuel = asof_join(days.select("date", F.explode(F.array(*[F.lit(f) for f in fuels])).alias("fuel_type")),
                     capacity.select("fuel_type", F.col("date").alias("_d"), "capacity_gw"),
                     on="date", right_on="_d", by=["fuel_type"], left_unique=True)
    base = fuel.groupBy("date").agg(F.sum("capacity_gw").alias("_base"))
    past = span_agg(days, queue, [], "date", [
        Span("_n", "count", None, -lookback_days), Span("_lo", "min", F.col("queue_backlog_gw"), -lookback_days),
        Span("_hi", "max", F.col("queue_backlog_gw"), -lookback_days)])
    df = now.join(base, "date", "left").join(past, "date", "left")
    raw, lo, hi = (ratio(c, "_base") for c in ("queue_backlog_gw", "_lo", "_hi"))
    score = (F.when(raw.isNull(), F.lit(0.0)).when(F.col("_n") < 2, F.least(raw, F.lit(1.0)))
             .when(hi == lo, F.lit(0.5)).otherwise(clip(ratio(raw - lo, hi - lo), 0.0, 1.0)))
    return df.select("date", score.alias("us_power_moat_score"))


def geo_tailwind(spine: DataFrame, energy: DataFrame, exposure: DataFrame,
                 regions: dict[str, list[str]] = REGION_COUNTRIES) -> DataFrame:
    """Exposure-weighted renewable growth and low carbon per (ticker, year), in [0, 1].

    The score depends on the day only through its year, so it is computed once per year.
    """
    years = spine.select(F.year("date").alias("year")).distinct()
    pairs = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(c).alias("country")) for r, cs in regions.items() for c in cs])
    probe = years.select(F.explode(F.array("year", F.col("year") - 1)).alias("_y")).distinct()
    probe = probe.select("_y", F.explode(pairs).alias("_p")).select("_y", "_p.*")
    facts = energy.select("country", F.col("year").alias("_fy"), F.col("renewables_pct").alias("_ren"),
                          F.col("carbon_intensity_gco2_per_kwh").alias("_co2"))
    hit = asof_join(probe, facts, on="_y", right_on="_fy", by=["country"], left_unique=True, matched_on="_found")
    by_region = hit.where(F.col("_found").isNotNull()).groupBy("region", "_y").agg(
        F.avg("_ren").alias("_ren"), F.avg("_co2").alias("_co2"))
    prior = by_region.select("region", (F.col("_y") + 1).alias("_y"), F.col("_ren").alias("_ren0"))
    df = by_region.join(prior, ["region", "_y"], "left")
    growth = F.greatest(F.lit(0.0), F.col("_ren") - F.coalesce("_ren0", "_ren"))
    wind = 0.6 * growth * 10 + 0.4 * (1.0 - clip(F.col("_co2") / 500.0, 0.0, 1.0))
    df = df.select("region", F.col("_y").alias("year"), wind.alias("_t")).where("_t is not null")
    tickers = spine.select("ticker", F.year("date").alias("year")).distinct()
    listed = exposure.select("ticker").distinct().withColumn("_listed", F.lit(True))
    weights = tickers.join(listed, "ticker", "left")
    default = weights.where("_listed is null").select(
        "ticker", "year", F.lit("north_america").alias("region"), F.lit(1.0).alias("weight"))
    weighted = weights.where("_listed").select("ticker", "year").join(exposure, "ticker").select(
        "ticker", "year", "region", "weight").unionByName(default)
    scored = weighted.join(F.broadcast(df), ["region", "year"]).groupBy("ticker", "year").agg(
        clip(ratio(F.sum(F.col("weight") * F.col("_t")), F.sum("weight")), 0.0, 1.0).alias("_s"))
    return tickers.join(scored, ["ticker", "year"], "left").select(
        "ticker", "year", zero_fill("_s").alias("geo_weighted_tailwind_score"))


def attach_energy(spine: DataFrame, zone_queue: DataFrame, capacity: DataFrame, energy: DataFrame,
                  exposure: DataFrame, power_tickers: list[str] = POWER_TICKERS) -> DataFrame:
    """Both energy scores on the spine; the moat applies only to the listed power companies."""
    moat = power_moat(spine, zone_queue, capacity)
    out = spine.join(F.broadcast(moat), "date", "left").withColumn(
        "us_power_moat_score", F.when(F.col("ticker").isin(power_tickers), zero_fill("us_power_moat_score")).otherwise(0.0))
    wind = geo_tailwind(spine, energy, exposure)
    return (out.withColumn("year", F.year("date")).join(wind, ["ticker", "year"], "left").drop("year"))
