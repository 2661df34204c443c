"""Landed feed payloads to typed rows. A payload is one row of JSON or delimited text plus its run date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidespine.functions.dates import parse_day, spreadsheet_day
from tidespine.functions.scalar import lookup
from tidespine.operators.match import tag_entities
from tidespine.operators.dedup import keep_first

# Fuel codes, zones, and queue-file headers (several spellings per column, file order wins).
FUELS = {"NG": "natural_gas", "NUC": "nuclear", "SUN": "solar", "WND": "wind"}
QUEUE_ZONES = ["AECO", "MAAC", "SWVA"]
QUEUE_HEADERS = {
    "queue_date": ["Queue Date", "Date Entered Queue", "q_date"],
    "project_name": ["Project Name", "Project", "project_name"],
    "mw": ["MW", "MW (DC)", "Capacity (MW)", "mw1"],
    "state": ["State", "State/Province/Territory", "state"],
    "fuel": ["Fuel", "Fuel Type", "type_clean"],
    "status": ["Status", "Interconnection Queue Status", "q_status"],
    "iso": ["ISO", "ISO/RTO", "Balancing Authority", "region"],
}
SNIPPET_CHARS = 500


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def short_volume(lines: DataFrame, watchlist: DataFrame, text: str = "value") -> DataFrame:
    """Pipe-delimited daily lines to short-volume ratios; bad numbers and zero totals are skipped.

    ``lines`` is (date, value); header lines drop out because their numbers do not parse.
    """
    p = F.split(text, r"\|")
    rows = lines.where(F.size(p) >= 5).select(
        "date", F.get(p, F.lit(1)).alias("ticker"), F.get(p, F.lit(2)).try_cast("double").alias("short_volume"),
        F.get(p, F.lit(4)).try_cast("double").alias("total_volume"))
    rows = rows.where("short_volume is not null and total_volume <> 0")
    return rows.join(watchlist.select("ticker").distinct(), "ticker", "left_semi").select(
        "date", "ticker", "short_volume", "total_volume",
        (F.col("short_volume") / F.col("total_volume")).alias("short_vol_ratio"))


_METRIC = "array<struct<cvssData struct<baseScore double>>>"
_VULNS = f"""vulnerabilities array<struct<cve struct<published string,
  metrics struct<cvssMetricV31 {_METRIC}, cvssMetricV30 {_METRIC}, cvssMetricV2 {_METRIC}>>>>"""


def vulnerabilities(payloads: DataFrame, text: str = "json") -> DataFrame:
    """Published vulnerabilities scored high or critical; the newest score version present decides."""
    cve = payloads.select(F.explode(F.from_json(text, _VULNS)["vulnerabilities"]).alias("v")).select("v.cve.*")
    versions = [F.col(f"metrics.{k}") for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")]
    score = F.lit(None).cast("double")
    for v in reversed(versions):
        score = F.when(F.size(v) > 0, v[0]["cvssData"]["baseScore"]).otherwise(score)
    rows = cve.select(parse_day(F.substring("published", 1, 10)).alias("date"), score.alias("_s"))
    return rows.where("date is not null and _s >= 7.0").select(
        "date", F.lit("nvd").alias("source"), F.when(F.col("_s") >= 9.0, "cve_critical").otherwise("cve_high").alias("metric"),
        F.lit(1.0).alias("value"))


def dated_entries(payloads: DataFrame, array: str, field: str, start: str, end: str, source: str, metric: str,
                  text: str = "json") -> DataFrame:
    """One metric row per feed entry dated inside [start, end]."""
    rows = payloads.select(F.explode(F.from_json(text, f"{array} array<struct<{field} string>>")[array]).alias("e"))
    day = parse_day(F.substring(f"e.{field}", 1, 10))
    return rows.select(day.alias("date")).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "date", F.lit(source).alias("source"), F.lit(metric).alias("metric"), F.lit(1.0).alias("value"))


def exploited_vulnerabilities(payloads: DataFrame, start: str, end: str) -> DataFrame:
    return dated_entries(payloads, "vulnerabilities", "dateAdded", start, end, "cisa", "cisa_kev")


def threat_pulses(payloads: DataFrame, start: str, end: str) -> DataFrame:
    return dated_entries(payloads, "results", "created", start, end, "otx", "otx_pulse")


_CONTRACTS = "array<struct<strike double, impliedVolatility double, openInterest double, volume double>>"


def option_chain(payloads: DataFrame, text: str = "json") -> DataFrame:
    """(ticker, date, expiry, json) with call and put lists to contract rows; missing numbers are 0."""
    doc = F.from_json(text, f"calls {_CONTRACTS}, puts {_CONTRACTS}")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), doc[f"{k}s"].alias("rows")) for k in ("call", "put")])
    rows = payloads.select("ticker", "date", "expiry", F.explode(sides).alias("s")).select(
        "ticker", "date", "expiry", F.col("s.side").alias("option_type"), F.explode("s.rows").alias("r"))
    num = lambda c: F.coalesce(F.nanvl(F.col(f"r.{c}"), F.lit(None).cast("double")), F.lit(0.0))
    return rows.select("ticker", "date", "expiry", "option_type", num("strike").alias("strike"),
                       num("impliedVolatility").alias("iv"), num("openInterest").cast("long").alias("oi"),
                       num("volume").cast("long").alias("volume"))


def job_openings(payloads: DataFrame, text: str = "json") -> DataFrame:
    """Monthly series document to rows; annual and malformed entries are skipped."""
    doc = F.from_json(text, "Results struct<series array<struct<seriesID string, data array<struct<year string, period string, value string>>>>>")
    rows = payloads.select("date", F.explode(doc["Results"]["series"]).alias("s")).select(
        "date", F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("d"))
    rows = rows.where(F.col("d.period").rlike("^M(0[1-9]|1[0-2])$"))
    return rows.select("date", "series_id", F.col("d.year").try_cast("int").alias("year"), F.col("d.period").alias("period"),
                       F.col("d.value").try_cast("double").alias("value")).where("year is not null and value is not null")


def macro_observations(payloads: DataFrame, text: str = "json") -> DataFrame:
    """(series_id, json) observations to (series_id, date, value); '.' is null, bad dates are skipped."""
    doc = F.from_json(text, "observations array<struct<date string, value string>>")
    rows = payloads.select("series_id", F.explode(doc["observations"]).alias("o"))
    return rows.select("series_id", parse_day("o.date").alias("date"),
                       F.nullif(F.col("o.value"), F.lit(".")).try_cast("double").alias("value")).where("date is not null")


def capacity_rows(payloads: DataFrame, text: str = "json") -> DataFrame:
    """Monthly capacity records to (date, fuel_type, capacity_gw); unknown fuels and gaps are skipped."""
    doc = F.from_json(text, "response struct<data array<struct<fueltypeid string, period string, capacity string>>>")
    rows = payloads.select(F.explode(doc["response"]["data"]).alias("r"))
    return rows.select(parse_day(F.concat("r.period", F.lit("-01"))).alias("date"),
                       lookup(F.col("r.fueltypeid"), FUELS).alias("fuel_type"),
                       F.col("r.capacity").try_cast("double").alias("capacity_gw")).where(
        "date is not null and fuel_type is not null and capacity_gw is not null")


def zone_backlog(rows: DataFrame, run_date: str, zones: list[str] = QUEUE_ZONES) -> DataFrame:
    """Queue rows (zone, mw, status) to one backlog row over the zones, without withdrawn projects."""
    kept = rows.where(F.trim("zone").isin(zones) & ~F.contains(F.lower(F.coalesce("status", F.lit(""))), F.lit("withdrawn")))
    mw = F.col("mw").try_cast("double")
    return kept.agg(F.round(F.coalesce(F.sum(mw), F.lit(0.0)) / 1000.0, 3).alias("queue_backlog_gw"),
                    F.count(mw).cast("int").alias("project_count")).select(
        F.lit(run_date).cast("date").alias("date"), F.lit("ALL_VIRGINIA").alias("zone"), "queue_backlog_gw", "project_count")


def canonical_columns(columns: list[str], headers: dict[str, list[str]] = QUEUE_HEADERS) -> dict[str, str]:
    """Canonical name -> source column: the first column in file order whose header is a known spelling."""
    found: dict[str, str] = {}
    for c in columns:
        for target, spellings in headers.items():
            if c in spellings and target not in found:
                found[target] = c
    return found


def queue_rows(raw: DataFrame, snapshot: str, states: list[str]) -> DataFrame:
    """Queue file with drifting headers to canonical typed rows of the wanted states."""
    source = canonical_columns(raw.columns)
    text = lambda t: F.col(f"`{source[t]}`").cast("string") if t in source else F.lit("")
    state = F.upper(F.trim(text("state")))
    return raw.where(state.isin(states)).select(
        F.lit(snapshot).cast("date").alias("snapshot_date"), spreadsheet_day(text("queue_date")).alias("queue_date"),
        _blank(text("project_name")).alias("project_name"),
        F.coalesce(text("mw").try_cast("double"), F.lit(0.0)).alias("mw"), state.alias("state"),
        *[_blank(text(c)).alias(c) for c in ("fuel", "status", "iso")])


def trade_rows(payloads: DataFrame, value_field: str, text: str = "json") -> DataFrame:
    """List-of-lists payload (header row first) to typed monthly rows; unparsable rows are skipped.

    ``payloads`` is (date, direction, hs_code, partner_code, json).
    """
    keys = ["date", "direction", "hs_code", "partner_code"]
    df = payloads.withColumn("_t", F.from_json(text, "array<array<string>>")).where(F.size("_t") >= 2)
    df = df.withColumn("_v", F.array_position(F.col("_t")[0], value_field)).withColumn(
        "_m", F.array_position(F.col("_t")[0], "time")).where("_v > 0 and _m > 0")
    rows = df.select(*keys, "_v", "_m", F.explode(F.slice("_t", 2, F.size("_t") - 1)).alias("r"))
    when = F.try_element_at("r", F.col("_m").cast("int"))
    return rows.select(*keys, F.substring(when, 1, 4).try_cast("int").alias("year"),
                       F.substring(when, 6, 2).try_cast("int").alias("month"),
                       F.try_element_at("r", F.col("_v").cast("int")).try_cast("double").alias("value_usd")).where(
        "year is not null and month is not null and value_usd is not null")


_AWARD = """awardee struct<name string, ueiSAM string>, award struct<amount string>, naicsCode string, department string,
  organizationHierarchy array<struct<name string>>"""


def award_rows(payloads: DataFrame, text: str = "json") -> DataFrame:
    """(date, json) award lists to rows with nested fallbacks."""
    doc = F.from_json(text, f"opportunitiesData array<struct<{_AWARD}>>, results array<struct<{_AWARD}>>")
    listed = F.when(F.size(doc["opportunitiesData"]) > 0, doc["opportunitiesData"]).otherwise(doc["results"])
    rows = payloads.select("date", F.explode(listed).alias("a"))
    org = F.try_element_at(F.col("a.organizationHierarchy"), F.lit(1))["name"]
    return rows.select("date", _blank(F.col("a.awardee.name")).alias("awardee_name"), _blank(F.col("a.awardee.ueiSAM")).alias("uei"),
                       F.coalesce(F.col("a.award.amount").try_cast("double"), F.lit(0.0)).alias("contract_value_usd"),
                       _blank(F.col("a.naicsCode")).alias("naics_code"),
                       _blank(F.coalesce(F.nullif(F.col("a.department"), F.lit("")), org)).alias("agency"))


def posting_rows(payloads: DataFrame, text: str = "json") -> DataFrame:
    """(date, keyword, page, json) search results to one row per posting id, first result wins."""
    item = "struct<MatchedObjectDescriptor struct<PositionID string, PositionTitle string, PublicationStartDate string>>"
    doc = F.from_json(text, f"SearchResult struct<SearchResultItems array<{item}>>")
    rows = payloads.select("date", "keyword", "page", F.posexplode(doc["SearchResult"]["SearchResultItems"]).alias("_i", "x"))
    d = "x.MatchedObjectDescriptor"
    rows = rows.select("date", F.col(f"{d}.PositionID").alias("posting_id"), _blank(F.col(f"{d}.PositionTitle")).alias("title"),
                       parse_day(F.substring(f"{d}.PublicationStartDate", 1, 10)).alias("posted_date"), "keyword", "page", "_i")
    rows = rows.where("posting_id <> '' and posted_date is not null")
    return keep_first(rows, ["posting_id"], ["keyword", "page", "_i"]).select(
        "date", "posting_id", "title", "posted_date", "keyword")


def patent_application_rows(payloads: DataFrame, text: str = "json") -> DataFrame:
    doc = F.from_json(text, "patents array<struct<assignee_organization string, app_id string, cpc_group_id string, app_date string>>")
    rows = payloads.select("date", F.explode(doc["patents"]).alias("r"))
    return rows.select("date", _blank(F.col("r.assignee_organization")).alias("assignee_name"), _blank(F.col("r.app_id")).alias("app_id"),
                       _blank(F.col("r.cpc_group_id")).alias("cpc_group"), parse_day("r.app_date").alias("filing_date")).where(
        "filing_date is not null")


def patent_grant_rows(payloads: DataFrame, text: str = "json") -> DataFrame:
    doc = F.from_json(text, "patents array<struct<assignee_organization string, patent_id string, cpc_group_id string, "
                            "patent_date string, cited_by_count string>>")
    rows = payloads.select("date", F.explode(doc["patents"]).alias("r"))
    return rows.select("date", _blank(F.col("r.assignee_organization")).alias("assignee_name"), _blank(F.col("r.patent_id")).alias("patent_id"),
                       _blank(F.col("r.cpc_group_id")).alias("cpc_group"), parse_day("r.patent_date").alias("grant_date"),
                       F.coalesce(F.col("r.cited_by_count").try_cast("int"), F.lit(0)).alias("forward_citation_count")).where(
        "grant_date is not null")


def news_rows(articles: DataFrame, aliases: DataFrame, source: str) -> DataFrame:
    """(timestamp, url, title, excerpt, tone) records to article rows, tagged by (entity, alias) rows; the first tone token is the tone.

    The snippet field is cut to its stored length, as a field limit; tags read the whole text.
    """
    title, body = _blank(F.col("title")), _blank(F.col("excerpt"))
    snippet = F.trim(F.substring(F.concat_ws(" ", title, body), 1, SNIPPET_CHARS))
    tone = F.split(F.coalesce(F.nullif(F.col("tone"), F.lit("")), F.lit("0")), ",")[0].try_cast("float")
    none = F.array().cast("array<string>")
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit("")))
    return tag_entities(articles, whole, aliases, "mentioned_tickers").select(
        "timestamp", F.lit(source).alias("source"), _blank(F.col("url")).alias("url"), title.alias("title"),
        snippet.alias("content_snippet"), none.alias("theme_tags"), F.lit(0.0).cast("float").alias("goldstein_score"),
        F.coalesce(tone, F.lit(0.0).cast("float")).alias("tone_score"), F.lit(1).alias("num_articles"),
        none.alias("actors"), none.alias("countries"), "mentioned_tickers")


def arrival_rows(records: DataFrame) -> DataFrame:
    """(airport, lastSeen, icao24, callsign, estDepartureAirport) to flight rows tagged by airport."""
    zero = F.lit(0.0)
    return records.select(
        F.timestamp_seconds("lastSeen").alias("timestamp"), _blank(F.col("icao24")).alias("icao24"),
        F.trim(_blank(F.col("callsign"))).alias("callsign"), _blank(F.col("estDepartureAirport")).alias("origin_country"),
        zero.alias("latitude"), zero.alias("longitude"), zero.alias("altitude_m"), zero.alias("velocity_ms"),
        F.lit(True).alias("on_ground"), F.lit("cargo").alias("aircraft_category"),
        F.concat(F.lit("cargo_arrival_"), "airport").alias("signal_type"))


def quarterly_spend(revenue: DataFrame, capex: DataFrame) -> DataFrame:
    """(ticker, period_end, value) twice to (ticker, period_end, revenue, capex) on common dates."""
    left = revenue.select("ticker", "period_end", F.col("value").cast("double").alias("revenue"))
    right = capex.select("ticker", "period_end", F.abs(F.col("value").cast("double")).alias("capex"))
    return left.join(right, ["ticker", "period_end"]).where("revenue is not null and capex is not null")


def price_rows(raw: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Landed price history with capitalised headers to the typed table."""
    return raw.select(F.col(ticker).alias("ticker"), F.to_date("Date").alias("date"),
                      *[F.col(c).try_cast("double").alias(n) for c, n in
                        (("Open", "open"), ("High", "high"), ("Low", "low"), ("Close", "close_price"))],
                      F.col("Volume").try_cast("long").alias("volume"))


def rate_rows(raw: DataFrame) -> DataFrame:
    return raw.select("pair", F.to_date("Date").alias("date"), F.col("Close").try_cast("double").alias("rate"))
