"""Extraction jobs, sinks and incremental reads. Landed payloads are built from the tables' rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidespine.catalog.base import query
from tidespine.catalog.views import DEAL_OF_LINE, case_col
from tidespine.functions.scalar import rounded
from tidespine.plans import filings as pf
from tidespine.schemas import empty
from tidespine.session import scratch_path
from tidespine.sources import feeds, filings as sf, readers as rd, sinks as sk

c, lit = F.col, F.lit


def text(x):
    return (c(x) if isinstance(x, str) else x).cast("string")


def landed(t, df, label):
    """Payloads as a feed leaves them, in a folder of files as the tables' tasks write them, without a shuffle: extraction jobs start from there."""
    path = scratch_path(t.spark, label)
    df.write.parquet(path)
    return t.spark.read.parquet(path)


# ---- scans -----------------------------------------------------------------------------------------


@query("s01_scan_entity_files", "SELECT ticker, date, close_price, volume FROM px")
def s01(t):
    path = scratch_path(t.spark, "ohlcv")
    t.px.withColumn("entity", c("ticker")).write.partitionBy("entity").parquet(path)
    return rd.scan(t.spark, f"{path}/*/*.parquet", "ohlcv").select("ticker", "date", "close_price", "volume")


@query("s02_views", "SELECT day AS date, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM ev GROUP BY 1")
def s02(t):
    path = scratch_path(t.spark, "events")
    sk.write_dates(t.ev.select(c("day").alias("date"), "event_id", "user_id"), path)
    made = rd.register_views(t.spark, {"v_events": path, "v_absent": path + "-absent"})
    assert made == ["v_events"]
    return t.spark.sql("SELECT date, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM v_events GROUP BY date")


@query("s03_absent_source", "SELECT ticker, date, NULL::DOUBLE AS short_vol_ratio_10d FROM px")
def s03(t):
    absent = rd.scan(t.spark, scratch_path(t.spark, "absent"), "short_interest")
    from tidespine.plans.events import short_interest_features

    return short_interest_features(t.px, absent).select("ticker", "date", "short_vol_ratio_10d")


@query("s04_evolving_scan", "SELECT ticker, quarter_end AS period_end, eps_actual AS gross_margin, CASE WHEN quarter_end >= DATE '1998-01-01' THEN eps_estimate END AS research_to_revenue FROM er")
def s04(t):
    path = scratch_path(t.spark, "fundamentals")
    new = t.er.select("ticker", c("quarter_end").alias("period_end"), c("eps_actual").alias("gross_margin"), c("eps_estimate").alias("research_to_revenue"))
    cut = lit("1998-01-01").cast("date")
    new.where(c("period_end") < cut).drop("research_to_revenue").write.parquet(f"{path}/old")
    new.where(c("period_end") >= cut).write.parquet(f"{path}/new")
    return rd.scan(t.spark, f"{path}/*/*.parquet", "fundamentals").select("ticker", "period_end", "gross_margin", "research_to_revenue")


@query("s05_csv_dimension", "SELECT date, party_a, party_b, deal_type, 'manual' AS source, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT date, party_a, party_b, deal_type FROM deals)")
def s05(t):
    path = scratch_path(t.spark, "deals")
    kind = case_col(c("l_linenumber"), DEAL_OF_LINE, "licensing_agreement")
    keys = t.deal_lines.select("day", "c_nationkey", "s_nationkey", "l_linenumber").distinct()  # at most days x nations x nations x lines
    deals = t.deal_parties(keys).select(c("day").alias("date"), "party_a", "party_b", kind.alias("deal_type")).distinct()
    deals.write.option("header", True).csv(path)
    out = rd.read_csv_table(t.spark, path, "deals", source="manual", confidence=1.0)
    return out.select("date", "party_a", "party_b", "deal_type", "source", "confidence")


@query("s05_default_row", """SELECT nat.ticker, COALESCE(region, 'north_america') AS region, COALESCE(weight, 1.0::DOUBLE) AS weight FROM nat LEFT JOIN exposure USING (ticker)""")
def s05_default(t):
    return rd.with_default(t.exposure, t.layers, "ticker", region="north_america", weight=1.0)


@query("s06_country_energy", """SELECT country, year, renewables_pct, CASE WHEN year % 2 = 0 THEN carbon_intensity_gco2_per_kwh END AS carbon FROM energy
 WHERE NOT (country = 'Norway' AND year % 2 = 1)""")
def s06(t):
    odd = c("year") % 2 == 1
    gone = (c("country") == "Norway") & odd
    raw = t.energy.select("country", text("year").alias("year"),
                          F.when(gone, "NA").otherwise(text("renewables_pct")).alias("renewables_share_elec"),
                          F.when(odd, "").otherwise(text("carbon_intensity_gco2_per_kwh")).alias("carbon_intensity_elec"),
                          *[lit("NA").alias(x) for x in rd.ENERGY_SIGNALS[1:-1]])
    other = raw.withColumn("country", F.concat(lit("Not "), "country"))
    return rd.country_energy(raw.unionByName(other)).select("country", "year", "renewables_pct", c("carbon_intensity_gco2_per_kwh").alias("carbon"))


# ---- delimited, XML and JSON payloads -----------------------------------------------------------------


@query("s07_short_volume", """SELECT day AS date, ticker, l_quantity AS short_volume, l_extendedprice AS total_volume, ROUND(l_quantity / l_extendedprice, 12) AS short_vol_ratio
 FROM li WHERE l_linenumber NOT IN (6, 7) AND layer <> 'ASIA'""")
def s07(t):
    short = F.when(c("l_linenumber") == 6, "n/a").otherwise(text("l_quantity"))
    total = F.when(c("l_linenumber") == 7, "0").otherwise(text("l_extendedprice"))
    lines = t.li.select(c("day").alias("date"), F.concat_ws("|", F.date_format("day", "yyyyMMdd"), "ticker", short, lit("0"), total, lit("Q")).alias("value"))
    watch = t.layers.where("layer <> 'ASIA'")
    header = lines.limit(1).withColumn("value", lit("Date|Symbol|ShortVolume|ShortExempt|TotalVolume|Market"))
    return rounded(feeds.short_volume(lines.unionByName(header), watch), 12)


@query("s08_filing_index", """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderdate::DATE::VARCHAR AS date_filed, 'edgar/' || o_orderkey::VARCHAR || '.txt' AS filename FROM orders WHERE o_orderstatus = 'F'""")
def s08(t):
    form = case_col(c("o_orderstatus"), {"F": "13F-HR", "O": "13F-HR/A"}, "10-K")
    lines = t.raw("orders").select(F.concat(
        lit("COMPANY "), text("o_custkey"), lit("    "), form, lit("   "), text("o_custkey"), lit("  "),
        text(F.to_date("o_orderdate")), lit("  "), F.concat(lit("edgar/"), text("o_orderkey"), lit(".txt")), lit("   ")).alias("value"))
    return sf.filing_index(lines)


@query("s09_holdings_xml", """SELECT p_partkey AS doc_id, 'C' || lpad(p_size::VARCHAR, 8, '0') AS cusip, 'T' || p_size::VARCHAR AS ticker, CAST(p_partkey * 1000 + 5 AS BIGINT) AS shares_held, CAST(floor(p_retailprice) AS BIGINT) AS value_usd_thousands
 FROM part WHERE p_size <= 25""")
def s09(t):
    cusip = F.concat(lit("C"), F.lpad(text("p_size"), 8, "0"))
    shares = F.format_number(c("p_partkey") * 1000 + 5, 0)

    def row(kind):
        return F.concat(lit("<ns1:infoTable><ns1:nameOfIssuer>"), "p_name", lit("</ns1:nameOfIssuer><ns1:cusip> "), cusip, lit(" </ns1:cusip><ns1:value>"),
                        text(F.floor("p_retailprice")), lit("</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), shares, lit("</ns1:sshPrnamt><ns1:sshPrnamtType>"),
                        lit(kind), lit("</ns1:sshPrnamtType></ns1:shrsOrPrnAmt></ns1:infoTable>"))
    docs = t.raw("part").select(c("p_partkey").alias("doc_id"), F.concat(
        lit('<ns1:informationTable xmlns:ns1="http://x.org/t">'), row("SH"), row("PRN"), lit("</ns1:informationTable>")).alias("xml"))
    known = t.raw("part").where("p_size <= 25").select(cusip.alias("cusip"), F.concat(lit("T"), text("p_size")).alias("ticker")).distinct()
    return sf.holdings(docs, known)


_ROLE = "CASE WHEN l_linenumber = 1 THEN 'CEO' WHEN l_linenumber = 2 THEN 'Director' WHEN l_linenumber = 3 THEN 'TenPercentOwner' ELSE '' END"


@query("s10_insider_xml", f"""SELECT ticker, day + 2 AS filed_date, day AS transaction_date, s_name AS insider_name, {_ROLE} AS insider_title, CASE l_returnflag WHEN 'R' THEN 'P' ELSE 'S' END AS transaction_code,
 l_quantity AS shares, l_extendedprice AS price_per_share, ROUND(l_quantity * l_extendedprice, 4) AS value FROM li WHERE l_returnflag <> 'N' AND l_linenumber <> 7""")
def s10(t):
    n = c("l_linenumber")
    title = F.when(n == 1, "<officerTitle> CEO </officerTitle>").otherwise("")
    roles = F.when(n == 2, "<isDirector>1</isDirector>").when(n == 3, "<isDirector>0</isDirector><isTenPercentOwner>1</isTenPercentOwner>").otherwise("<isDirector>0</isDirector>")
    code = case_col(c("l_returnflag"), {"R": "P", "A": "S"}, "G")
    xml = F.concat(
        lit('<ownershipDocument xmlns="http://x.org/o"><reportingOwner><reportingOwnerId><rptOwnerName>'), "s_name",
        lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"), roles, title,
        lit("</reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>"), text("day"),
        lit("</value></transactionDate><transactionCoding><transactionCode>"), code, lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"),
        F.when(n == 7, "many").otherwise(text("l_quantity")), lit("</value></transactionShares><transactionPricePerShare><value>"), text("l_extendedprice"),
        lit("</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"))
    docs = t.li.select("ticker", F.date_add("day", 2).alias("filed_date"), xml.alias("xml"))
    return rounded(sf.insider_transactions(landed(t, docs, "ownership")), 4)


_LETTERS = "translate(c_nationkey::VARCHAR, '0123456789', 'ABCDEFGHIJ')"


@query("s11_disclosure_text", f"""WITH o AS (SELECT o_orderkey AS doc_id, 'N' || {_LETTERS} AS tk, 'M' || {_LETTERS} AS tk2, CAST(o_orderdate AS DATE) AS d, c_name, c_nationkey AS k, o_orderstatus AS st,
 CAST(floor(o_totalprice) AS DOUBLE) AS p FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT doc_id, tk AS ticker, d AS trade_date, c_name AS politician_name, 'house' AS chamber, '' AS party, CASE WHEN st = 'F' THEN 'purchase' ELSE 'sale' END AS transaction_type,
 1001.0::DOUBLE AS amount_low, 1001.0::DOUBLE + p AS amount_high, (1001.0 + 1001.0 + p) / 2 AS amount_mid FROM o WHERE k < 20
 UNION ALL SELECT doc_id, tk2, d + 1, c_name, 'house', '', 'sale', 200.0, 200.0, 200.0 FROM o WHERE k < 20""")
def s11(t):
    o = t.raw("orders").join(t.raw("customer"), c("o_custkey") == c("c_custkey"))
    letters = F.translate(text("c_nationkey"), "0123456789", "ABCDEFGHIJ")
    day = F.to_date("o_orderdate")
    us = lambda x: F.date_format(x, "MM/dd/yyyy")
    kind = F.when(c("o_orderstatus") == "F", "P").otherwise("S")
    high = F.format_number(F.floor("o_totalprice") + 1001, 0)
    first = F.concat(lit("Common Stock (N"), letters, lit(") "), kind, lit(" "), us(day), lit(" $1,001 - $"), high)
    wrapped = F.concat(lit("S (partial) "), us(F.date_add(day, 1)), lit(" $200\nheld in trust\nnote\nOther Corp (M"), letters, lit(")"))
    body = F.concat(lit("Filing\n"), first, lit("\n"), first, lit("\n\n\n\n"), wrapped, lit("\nno trade (N"), letters, lit(")"))
    docs = o.select(c("o_orderkey").alias("doc_id"), c("c_name").alias("politician_name"), body.alias("text"))
    watch = o.where("c_nationkey < 20").select(F.explode(F.array(F.concat(lit("N"), letters), F.concat(lit("M"), letters))).alias("ticker")).distinct()
    return sf.disclosure_trades(landed(t, docs, "disclosures"), watch)


@query("s12_fact_json", """SELECT ticker, day AS "start", day + 90 AS "end", o_totalprice AS val, day + 120 AS filed, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form, 'a' || o_orderkey::VARCHAR AS accn
 FROM ord WHERE o_orderstatus <> 'P'""")
def s12(t):
    form = case_col(c("o_orderstatus"), {"F": "10-K", "O": "10-Q"}, "8-K")
    item = F.struct(text("day").alias("start"), text(F.date_add("day", 90)).alias("end"), c("o_totalprice").alias("val"),
                    text(F.date_add("day", 120)).alias("filed"), form.alias("form"), F.concat(lit("a"), text("o_orderkey")).alias("accn"))
    docs = t.ord.select("ticker", F.to_json(F.struct(F.struct(F.array(item).alias("USD")).alias("units"))).alias("json"))
    return sf.fact_rows(docs)


@query("s13_vulnerabilities", """SELECT day AS date, 'nvd' AS source, CASE WHEN s >= 9.0 THEN 'cve_critical' ELSE 'cve_high' END AS metric, 1.0::DOUBLE AS value
 FROM (SELECT day, least(value, 100.0) / 10.0 AS s, user_id FROM ev) WHERE s >= 7.0 AND user_id % 4 <> 3""")
def s13(t):
    score = F.struct(F.struct((F.least(c("value"), lit(100.0)) / 10.0).alias("baseScore")).alias("cvssData"))
    low = F.struct(F.struct(lit(0.5).alias("baseScore")).alias("cvssData"))
    v = c("user_id") % 4
    arr = lambda e: F.array(e)
    metrics = F.struct(F.when(v == 0, arr(score)).alias("cvssMetricV31"), F.when(v == 1, arr(score)).when(v == 0, arr(low)).alias("cvssMetricV30"),
                       F.when(v == 2, arr(score)).when(v < 2, arr(low)).alias("cvssMetricV2"))
    cve = F.struct(F.struct(F.concat(text("day"), lit("T10:00:00")).alias("published"), metrics.alias("metrics")).alias("cve"))
    return feeds.vulnerabilities(t.ev.select(F.to_json(F.struct(F.array(cve).alias("vulnerabilities"))).alias("json")))


@query("s14_threat_feeds", """SELECT day AS date, 'cisa' AS source, 'cisa_kev' AS metric, 1.0::DOUBLE AS value FROM ev WHERE event_type = 'click' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
 UNION ALL SELECT day, 'otx', 'otx_pulse', 1.0 FROM ev WHERE event_type = 'view' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def s14(t):
    span = ("2024-01-05", "2024-01-20")
    kev = t.ev.where("event_type = 'click'").select(F.to_json(F.struct(F.array(
        F.struct(text("day").alias("dateAdded")), F.struct(lit("unknown").alias("dateAdded"))).alias("vulnerabilities"))).alias("json"))
    otx = t.ev.where("event_type = 'view'").select(F.to_json(F.struct(F.array(F.struct(text("ts").alias("created"))).alias("results"))).alias("json"))
    return feeds.exploited_vulnerabilities(kev, *span).unionByName(feeds.threat_pulses(otx, *span))


@query("s15_option_chain", """SELECT ticker, day AS date, day + 30 AS expiry, k AS option_type, CASE k WHEN 'call' THEN l_extendedprice ELSE l_extendedprice / 2 END AS strike, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_discount END AS iv,
 CAST(l_quantity AS BIGINT) AS oi, CAST(0 AS BIGINT) AS volume FROM li, (VALUES ('call'), ('put')) v(k)""")
def s15(t):
    def side(strike):
        return F.array(F.struct(strike.alias("strike"), F.when(c("l_linenumber") != 1, c("l_discount")).alias("impliedVolatility"),
                                c("l_quantity").alias("openInterest")))
    docs = t.li.select("ticker", c("day").alias("date"), F.date_add("day", 30).alias("expiry"),
                       F.to_json(F.struct(side(c("l_extendedprice")).alias("calls"), side(c("l_extendedprice") / 2).alias("puts"))).alias("json"))
    return feeds.option_chain(docs)


@query("s16_job_openings", "SELECT day AS date, 'S' || l_linenumber::VARCHAR AS series_id, CAST(year(day) AS INTEGER) AS year, 'M' || lpad(month(day)::VARCHAR, 2, '0') AS period, l_quantity AS value FROM li")
def s16(t):
    row = lambda p, v: F.struct(text(F.year("day")).alias("year"), p.alias("period"), v.alias("value"))
    month = F.concat(lit("M"), F.lpad(text(F.month("day")), 2, "0"))
    data = F.array(row(month, text("l_quantity")), row(lit("M13"), lit("1")), row(month, lit("-")))
    series = F.array(F.struct(F.concat(lit("S"), text("l_linenumber")).alias("seriesID"), data.alias("data")))
    return feeds.job_openings(t.li.select(c("day").alias("date"), F.to_json(F.struct(F.struct(series.alias("series")).alias("Results"))).alias("json")))


@query("s17_macro_observations", "SELECT o_orderpriority AS series_id, day AS date, o_totalprice AS value FROM ord UNION ALL SELECT o_orderpriority, day + 1, NULL FROM ord")
def s17(t):
    row = lambda d0, v: F.struct(d0.alias("date"), v.alias("value"))
    obs = F.array(row(text("day"), text("o_totalprice")), row(text(F.date_add("day", 1)), lit(".")), row(lit("soon"), lit("1")))
    return feeds.macro_observations(t.ord.select(c("o_orderpriority").alias("series_id"), F.to_json(F.struct(obs.alias("observations"))).alias("json")))


@query("s18_capacity", """SELECT CAST(date_trunc('month', day) AS DATE) AS date, CASE l_linenumber WHEN 1 THEN 'nuclear' WHEN 2 THEN 'natural_gas' WHEN 3 THEN 'solar' ELSE 'wind' END AS fuel_type, l_quantity AS capacity_gw FROM li WHERE l_linenumber <= 4""")
def s18(t):
    fuel = case_col(c("l_linenumber"), {1: "NUC", 2: "NG", 3: "SUN", 4: "WND"}, "OTH")
    rec = F.struct(fuel.alias("fueltypeid"), F.date_format("day", "yyyy-MM").alias("period"), text("l_quantity").alias("capacity"))
    return feeds.capacity_rows(t.li.select(F.to_json(F.struct(F.struct(F.array(rec).alias("data")).alias("response"))).alias("json")))


@query("s19_zone_backlog", """SELECT DATE '2002-01-01' AS date, 'ALL_VIRGINIA' AS zone, ROUND(CAST(SUM(floor(o_totalprice)) AS DOUBLE) / 1000.0, 3) AS queue_backlog_gw, CAST(COUNT(*) AS INTEGER) AS project_count FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def s19(t):
    rows = t.raw("orders").select(case_col(c("o_orderpriority"), {"1-URGENT": "MAAC ", "5-LOW": "AECO"}, "PSEG").alias("zone"),
                                  F.when(c("o_orderstatus") == "P", "Withdrawn - late").otherwise("Active").alias("status"), text(F.floor("o_totalprice")).alias("mw"))
    return feeds.zone_backlog(rows, "2002-01-01")


@query("s20_queue_file", """SELECT DATE '2002-06-30' AS snapshot_date, queue_date, project_name, CASE WHEN mw > 40 THEN 0.0 ELSE mw END AS mw, state, '' AS fuel, '' AS status, 'PJM' AS iso
 FROM queue WHERE state IN ('AZ', 'GA', 'NV', 'OH', 'OR', 'TX', 'VA', 'WA')""")
def s20(t):
    from tidespine.plans.macro import DATA_CENTER_STATES

    serial = text(F.date_diff("queue_date", lit("1899-12-30").cast("date")))
    when = F.when(c("state") == "TX", serial).when(c("state") == "VA", F.date_format("queue_date", "M/d/yyyy")).otherwise(text("queue_date"))
    raw = t.queue.select(when.alias("Date Entered Queue"), c("project_name").alias("Project"), F.when(c("mw") > 40, "tbd").otherwise(text("mw")).alias("MW (DC)"),
                         F.concat(lit(" "), F.lower("state")).alias("State"), lit(None).cast("string").alias("Status"), lit("PJM").alias("ISO/RTO"), lit("x").alias("region"))
    return feeds.queue_rows(raw, "2002-06-30", DATA_CENTER_STATES)


@query("s21_trade_payload", "SELECT day AS date, 'import' AS direction, '8541' AS hs_code, 'ALL' AS partner_code, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, l_extendedprice AS value_usd FROM li WHERE l_linenumber <> 7")
def s21(t):
    row = F.array(F.date_format("day", "yyyy-MM"), lit("x"), F.when(c("l_linenumber") == 7, "none").otherwise(text("l_extendedprice")))
    table = F.array(F.array(lit("time"), lit("CTY"), lit("GEN_VAL")), row)
    docs = t.li.select(c("day").alias("date"), lit("import").alias("direction"), lit("8541").alias("hs_code"), lit("ALL").alias("partner_code"), F.to_json(table).alias("json"))
    return feeds.trade_rows(docs, "GEN_VAL")


@query("s22_award_json", """SELECT day AS date, s_name AS awardee_name, '' AS uei, l_extendedprice AS contract_value_usd, '541511' AS naics_code, CASE WHEN l_linenumber % 2 = 0 THEN 'DEPT' ELSE 'ORG' END AS agency FROM li""")
def s22(t):
    award = F.struct(F.struct(c("s_name").alias("name")).alias("awardee"), F.struct(text("l_extendedprice").alias("amount")).alias("award"), lit("541511").alias("naicsCode"),
                     F.when(c("l_linenumber") % 2 == 0, "DEPT").otherwise("").alias("department"), F.array(F.struct(lit("ORG").alias("name"))).alias("organizationHierarchy"))
    key = F.when(c("l_returnflag") == "R", F.to_json(F.struct(F.array(award).alias("opportunitiesData")))).otherwise(F.to_json(F.struct(F.array(award).alias("results"))))
    return feeds.award_rows(t.li.select(c("day").alias("date"), key.alias("json")))


@query("s23_postings_json", """SELECT date, posting_id, title, posted_date, keyword FROM (SELECT day AS date, (event_id // 2)::VARCHAR AS posting_id, event_type AS title, day - 3 AS posted_date, event_type AS keyword,
 row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_type, event_id) AS rn FROM ev) WHERE rn = 1""")
def s23(t):
    d0 = F.struct(F.floor(c("event_id") / 2).cast("string").alias("PositionID"), c("event_type").alias("PositionTitle"), F.concat(text(F.date_sub("day", 3)), lit("T00:00:00")).alias("PublicationStartDate"))
    bad = F.struct(lit("").alias("PositionID"), lit("x").alias("PositionTitle"), lit("soon").alias("PublicationStartDate"))
    items = F.array(F.struct(bad.alias("MatchedObjectDescriptor")), F.struct(d0.alias("MatchedObjectDescriptor")))
    docs = t.ev.select(c("day").alias("date"), c("event_type").alias("keyword"), c("event_id").alias("page"),
                       F.to_json(F.struct(F.struct(items.alias("SearchResultItems")).alias("SearchResult"))).alias("json"))
    return feeds.posting_rows(docs)


@query("s24_patent_applications", "SELECT date, assignee_name, app_id::VARCHAR AS app_id, cpc_group, filing_date FROM apps WHERE cpc_group <> 'X'")
def s24(t):
    rec = F.struct(c("assignee_name").alias("assignee_organization"), text("app_id").alias("app_id"), c("cpc_group").alias("cpc_group_id"),
                   F.when(c("cpc_group") == "X", "n/a").otherwise(text("filing_date")).alias("app_date"))
    return feeds.patent_application_rows(t.apps.select("date", F.to_json(F.struct(F.array(rec).alias("patents"))).alias("json")))


@query("s24_patent_grants", "SELECT date, assignee_name, patent_id::VARCHAR AS patent_id, '' AS cpc_group, grant_date, CASE WHEN forward_citation_count > 40 THEN 0 ELSE forward_citation_count END AS forward_citation_count FROM grants")
def s24_grants(t):
    rec = F.struct(c("assignee_name").alias("assignee_organization"), text("patent_id").alias("patent_id"), text("grant_date").alias("patent_date"),
                   F.when(c("forward_citation_count") <= 40, text("forward_citation_count")).otherwise("many").alias("cited_by_count"))
    return feeds.patent_grant_rows(t.grants.select("date", F.to_json(F.struct(F.array(rec).alias("patents"))).alias("json")))


_EDGE = r"[^\p{L}\p{N}_]"


@query("s25_news_rows", rf"""SELECT doc_id::VARCHAR AS url, lang AS title, trim(left(lang || ' ' || text, 500)) AS content_snippet, CAST(CAST(n_chars AS FLOAT) AS FLOAT) AS tone_score,
 array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(lower(lang || ' ' || text), '(^|{_EDGE})(en|the)($|{_EDGE})') THEN 'ENG' END, CASE WHEN regexp_matches(lower(lang || ' ' || text), '(^|{_EDGE})(fr|le)($|{_EDGE})') THEN 'FRA' END], lambda x: x IS NOT NULL)), ',') AS tags FROM documents""")
def s25(t):
    aliases = t.spark.createDataFrame([("ENG", "en"), ("ENG", "the"), ("FRA", "fr"), ("FRA", "le")], "entity string, alias string")
    arts = t.raw("documents").select(lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"), text("doc_id").alias("url"), c("lang").alias("title"),
                                     c("text").alias("excerpt"), F.concat(text("n_chars"), lit(",1,2")).alias("tone"))
    out = feeds.news_rows(arts, aliases, "gdelt")
    return out.select("url", "title", "content_snippet", "tone_score", F.array_join("mentioned_tickers", ",").alias("tags"))


@query("s26_submissions", """SELECT c_custkey AS cik, replace('0001-' || o_orderkey::VARCHAR, '-', '') AS accession, CAST(o_orderdate AS DATE) AS filed, 'doc.xml' AS primary_doc FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= greatest(DATE '2001-01-01' - 365 * 3, DATE '1997-01-01')""")
def s26(t):
    day = text(F.to_date("o_orderdate"))
    code = F.when(c("o_orderstatus") == "F", "4").otherwise("8-K")
    both = lambda a, b: F.array(a, b)
    block = F.struct(both(code, lit("4")).alias("form"), both(F.concat(lit("0001-"), text("o_orderkey")), lit("9")).alias("accessionNumber"),
                     both(day, day).alias("filingDate"), both(lit("doc.xml"), lit("scan.pdf")).alias("primaryDocument"))
    docs = t.raw("orders").select(c("o_custkey").alias("cik"), F.to_json(block).alias("json"))
    cutoff = sf.cutoff_date("2001-01-01", 3, lit("1997-01-01").cast("date"))
    return sf.submissions(docs, "4", cutoff, ".xml")


@query("s27_arrivals", "SELECT event_id, 'cargo_arrival_' || event_type AS signal_type, 'c' || user_id::VARCHAR AS callsign, CAST(ts AS DATE) AS date FROM events")
def s27(t):
    recs = t.raw("events").select(c("event_type").alias("airport"), F.unix_timestamp(c("ts").cast("timestamp")).alias("lastSeen"), text("event_id").alias("icao24"),
                                  F.concat(lit(" c"), text("user_id"), lit("  ")).alias("callsign"), lit(None).cast("string").alias("estDepartureAirport"))
    out = feeds.arrival_rows(recs)
    return out.select(c("icao24").cast("long").alias("event_id"), "signal_type", "callsign", F.to_date("timestamp").alias("date"))


@query("s28_quarterly_spend", "SELECT ticker, period_end, revenue, capex FROM fq WHERE quarter(period_end) <> 2")
def s28(t):
    rev = t.fq.select("ticker", "period_end", c("revenue").alias("value"))
    cap = t.fq.where(F.quarter("period_end") != 2).select("ticker", "period_end", (-c("capex")).alias("value"))
    return feeds.quarterly_spend(rev, cap)


@query("s29_surprises", "SELECT ticker, quarter_end, eps_surprise, eps_surprise_pct FROM er")
def s29(t):
    return pf.surprises(t.er.select("ticker", "quarter_end", "eps_actual", "eps_estimate")).select("ticker", "quarter_end", "eps_surprise", "eps_surprise_pct")


@query("s30_statement", """SELECT ticker, period_end, ROUND((revenue - LAG(revenue, 4) OVER w) / abs(NULLIF(LAG(revenue, 4) OVER w, 0)), 6) AS revenue_growth_yoy, ROUND(gross_profit / revenue, 6) AS gross_margin,
 ROUND(CASE WHEN equity > 0 THEN long_term_debt / equity END, 6) AS debt_to_equity, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) = 1 THEN 10.0::DOUBLE END AS pe_ratio_trailing
 FROM fq WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""")
def s30(t):
    q = t.fq.withColumn("total_debt", c("long_term_debt")).withColumns({k: lit(v) for k, v in (("pe", 10.0), ("ps", 2.0), ("pb", 3.0))})
    return rounded(pf.statement_quarters(q).select("ticker", "period_end", "revenue_growth_yoy", "gross_margin", "debt_to_equity", "pe_ratio_trailing"))


# ---- sinks and incremental reads ----------------------------------------------------------------------


@query("s31_sink_per_entity", "SELECT ticker, date, close_price, volume FROM px")
def s31(t):
    path = scratch_path(t.spark, "entity")
    sk.write_per_entity(t.px, path)
    return t.spark.read.parquet(path).select("ticker", "date", "close_price", "volume")


@query("s32_sink_entity_years", "SELECT ticker, CAST(year(date) AS INTEGER) AS year, date, close_price, volume FROM px")
def s32(t):
    path = scratch_path(t.spark, "years")
    sk.write_entity_years(t.px, path)
    return t.spark.read.parquet(path).select("ticker", "year", "date", "close_price", "volume")


@query("s33_sink_dates", "SELECT ticker, date, horizon, expected_annual_return, CASE WHEN date < DATE '1998-01-01' THEN 2 ELSE 1 END AS version FROM preds")
def s33(t):
    path = scratch_path(t.spark, "preds")
    sk.write_by(t.preds.withColumn("month", F.trunc("date", "month")).withColumn("version", lit(1)), path, "month", "horizon")
    again = t.preds.where("date < date'1998-01-01'").withColumn("month", F.trunc("date", "month")).withColumn("version", lit(2))
    sk.write_by(again, path, "month", "horizon")
    back = rd.read_partitions(t.spark, path, "ticker string, date date, expected_annual_return double, version int, month date, horizon string")
    return back.select("ticker", "date", "horizon", "expected_annual_return", "version")


@query("s34_upsert", "SELECT pair, date, CASE WHEN date >= DATE '1998-01-01' THEN rate * 2 ELSE rate END AS rate FROM rates")
def s34(t):
    path = scratch_path(t.spark, "fx")
    rates = t.rates.withColumn("month", F.date_format("date", "yyyy-MM"))
    sk.upsert_table(t.spark, path, rates.where("date < date'1999-01-01'"), ["pair", "date"], "month")
    sk.upsert_table(t.spark, path, rates.where("date >= date'1998-01-01'").withColumn("rate", c("rate") * 2), ["pair", "date"], "month")
    return t.spark.read.parquet(path).select("pair", "date", "rate")


_PERIOD = {"week": "date_trunc('week', date)", "month": "date_trunc('month', date)", "half_year": "make_date(year(date)::INTEGER, CASE WHEN month(date) <= 6 THEN 1 ELSE 7 END, 1)"}


@query("s35_snapshot_guard", "WITH w AS (SELECT DISTINCT date FROM px), e AS (SELECT DISTINCT date FROM rates WHERE rate > 1.6) " + " UNION ALL ".join(
    f"SELECT '{k}' AS period, w.date FROM w WHERE {v.replace('date)', 'w.date)')} NOT IN (SELECT {v} FROM e)" for k, v in _PERIOD.items()))
def s35(t):
    wanted = t.px.select("date").distinct()
    have = t.rates.where("rate > 1.6").select("date").distinct()
    out = None
    for k in _PERIOD:
        part = sk.missing_snapshots(wanted, have, k).select(lit(k).alias("period"), "date")
        out = part if out is None else out.unionByName(part)
    return out


@query("s36_incremental_days", "SELECT day AS date, COUNT(*) AS n FROM ev WHERE day NOT IN (SELECT day FROM news WHERE net_sentiment < 0) GROUP BY 1")
def s36(t):
    done = scratch_path(t.spark, "scored-days")
    sk.write_dates(t.news.where("net_sentiment < 0").select(F.to_date("timestamp").alias("date"), "net_sentiment"), done)
    return sk.unprocessed(t.ev.withColumnRenamed("day", "date"), done).groupBy("date").agg(F.count(lit(1)).alias("n"))


@query("s37_latest_partition", "SELECT ticker, date, close_price FROM px WHERE date_trunc('month', date) = (SELECT date_trunc('month', MAX(date)) FROM px)")
def s37(t):
    path = scratch_path(t.spark, "by-day")
    sk.write_by(t.px.withColumn("month", F.date_format("date", "yyyy-MM")), path, "month")
    return rd.latest_partition(t.spark, path, "month").select("ticker", "date", "close_price")


@query("s38_entity_history", "SELECT ticker, date, close_price FROM px WHERE ticker = 'NATION_7' ORDER BY date")
def s38(t):
    path = scratch_path(t.spark, "clustered")
    sk.write_clustered(t.px, path)
    return rd.entity_history(t.spark.read.parquet(path), "NATION_7").select("ticker", "date", "close_price")


@query("s38_last_rows", "SELECT ticker, period_end, revenue FROM fq WHERE ticker = 'NATION_7' ORDER BY period_end DESC LIMIT 4")
def s38_last(t):
    path = scratch_path(t.spark, "clustered")
    sk.write_clustered(t.fq, path, on="period_end")
    return rd.last_rows(t.spark.read.parquet(path), "NATION_7", 4, "period_end").select("ticker", "period_end", "revenue")


@query("s39_preferred_set", """WITH h AS (SELECT date, ticker, CASE WHEN day(date) % 3 = 0 THEN horizon WHEN horizon = '5d' THEN '252d' ELSE '756d' END AS horizon FROM preds),
 b AS (SELECT date, arg_min(horizon, CASE WHEN horizon = '252d' THEN '0' ELSE '1' || horizon END) AS horizon FROM h GROUP BY 1) SELECT h.* FROM h SEMI JOIN b USING (date, horizon)""")
def s39(t):
    h = F.when(F.day("date") % 3 == 0, c("horizon")).when(c("horizon") == "5d", "252d").otherwise("756d")
    return rd.preferred_predictions(t.preds.select("date", "ticker", h.alias("horizon"))).select("date", "ticker", "horizon")


@query("s40_registry", """SELECT 'layer' AS kind, ticker AS value FROM nat WHERE layer = 'EUROPE' UNION ALL SELECT DISTINCT 'layers', layer FROM nat UNION ALL SELECT 'foreign', ticker FROM currencies WHERE currency <> 'USD'
 UNION ALL SELECT 'currency', currency FROM currencies WHERE ticker = 'NATION_3' UNION ALL SELECT 'listed', ticker FROM nat WHERE layer = 'AFRICA'""")
def s40(t):
    reg = rd.Registry(t.layers.join(t.currencies, "ticker").withColumn("exchange", F.when(c("layer") == "AFRICA", "US").otherwise("X")))
    tag = lambda df, kind, col: df.select(lit(kind).alias("kind"), c(col).alias("value"))
    return (tag(reg.in_layer("EUROPE"), "layer", "ticker").unionByName(tag(reg.layers(), "layers", "layer")).unionByName(tag(reg.non_base(), "foreign", "ticker"))
            .unionByName(tag(reg.currency_of("NATION_3"), "currency", "currency")).unionByName(tag(reg.listed_at(), "listed", "ticker")))


@query("s41_watermark", """WITH s AS (SELECT ticker, MAX(transaction_date) AS since FROM tr WHERE transaction_date < DATE '2001-06-01' AND ticker <> 'NATION_4' GROUP BY 1)
 SELECT tr.ticker, COUNT(*) AS n, MIN(transaction_date) AS first_day FROM tr LEFT JOIN s USING (ticker) WHERE since IS NULL OR transaction_date >= since GROUP BY 1""")
def s41(t):
    stored = t.tr.where("transaction_date < date'2001-06-01' and ticker <> 'NATION_4'")
    return sk.after_watermark(t.tr, stored, "transaction_date").groupBy("ticker").agg(F.count(lit(1)).alias("n"), F.min("transaction_date").alias("first_day"))


@query("s42_sink_table", "SELECT ticker, quarter_end, eps_actual FROM er")
def s42(t):
    path = scratch_path(t.spark, "earnings")
    sk.write_table(t.er, path)
    return t.spark.read.parquet(path).select("ticker", "quarter_end", "eps_actual")


@query("s43_guarded_sink", "SELECT DATE '2003-01-15' AS date, COUNT(*) AS n FROM jolts UNION ALL SELECT DATE '2003-02-01', COUNT(*) FROM jolts")
def s43(t):
    path = scratch_path(t.spark, "openings")
    extract = lambda: t.jolts.drop("date")
    ran = [sk.guarded_write(t.spark, path, day, "month", extract) for day in ("2003-01-15", "2003-01-20", "2003-02-01")]
    assert ran == [True, False, True]
    assert not sk.guarded_write(t.spark, path, "2003-03-01", "month", lambda: empty(t.spark, "jolts"))
    return t.spark.read.parquet(path).groupBy("date").agg(F.count(lit(1)).alias("n"))


@query("s44_landed_prices", "SELECT ticker, date, close_price, volume FROM px")
def s44(t):
    raw = t.px.select("ticker", text("date").alias("Date"), *[text("close_price").alias(x) for x in ("Open", "High", "Low", "Close")], text("volume").alias("Volume"))
    return feeds.price_rows(raw).select("ticker", "date", "close_price", "volume")


@query("s44_landed_rates", "SELECT pair, date, rate FROM rates")
def s44_rates(t):
    return feeds.rate_rows(t.rates.select("pair", text("date").alias("Date"), text("rate").alias("Close")))


@query("s45_report_index", """SELECT c_name AS last, o_orderpriority AS first, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey::VARCHAR AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '2001-07-01' - 365""")
def s45(t):
    xml = F.concat(lit("<FinancialDisclosure><Member><Last>"), "c_name", lit("</Last><First>"), "o_orderpriority", lit("</First><FilingType>"), "o_orderstatus",
                   lit("</FilingType><FilingDate>"), F.date_format("o_orderdate", "M/d/yyyy"), lit("</FilingDate><DocID>"), text("o_orderkey"), lit("</DocID></Member></FinancialDisclosure>"))
    docs = t.raw("orders").join(t.raw("customer"), c("o_custkey") == c("c_custkey")).select(xml.alias("xml"))
    return sf.report_index(docs, "2001-07-01", 365)


@query("s46_latest_filing", "SELECT o_custkey AS cik, MAX(CAST(o_orderdate AS DATE)) AS date_filed, arg_max(lpad(o_orderkey::VARCHAR, 9, '0'), {'d': o_orderdate, 'k': lpad(o_orderkey::VARCHAR, 9, '0')}) AS filename FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def s46(t):
    f = t.raw("orders").select(c("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("date_filed"), F.lpad(text("o_orderkey"), 9, "0").alias("filename"), c("o_orderstatus").alias("form"))
    return sf.latest_filing(f, "cik", "F")


@query("s47_combined_extracts", "SELECT ticker, transaction_date AS date, 'a' AS src FROM tr WHERE transaction_date BETWEEN DATE '2001-06-30' - 365 AND DATE '2001-06-30' UNION ALL SELECT ticker, trade_date, 'b' FROM cg WHERE trade_date BETWEEN DATE '2001-06-30' - 365 AND DATE '2001-06-30'")
def s47(t):
    return sk.combine_extracts([t.tr.select("ticker", c("transaction_date").alias("date"), lit("a").alias("src")),
                                t.cg.select("ticker", c("trade_date").alias("date"), lit("b").alias("src"))], "2001-06-30", 365)


