"""Filing documents to typed rows. Each document is one row with its text; no document is cut."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tidespine.functions.dates import parse_day

FACT_FORMS = ["10-K", "10-Q", "20-F"]
OPEN_MARKET_CODES = ["P", "S"]

_HOLDINGS = """infoTable array<struct<nameOfIssuer string, cusip string, value string,
  shrsOrPrnAmt struct<sshPrnamt string, sshPrnamtType string>>>"""
_OWNERSHIP = """reportingOwner array<struct<reportingOwnerId struct<rptOwnerName string>,
  reportingOwnerRelationship struct<isDirector string, isOfficer string, isTenPercentOwner string, officerTitle string>>>,
  nonDerivativeTable struct<nonDerivativeTransaction array<struct<
    transactionDate struct<value string>, transactionCoding struct<transactionCode string>,
    transactionAmounts struct<transactionShares struct<value string>, transactionPricePerShare struct<value string>>>>>"""
_MEMBERS = "Member array<struct<Last string, First string, FilingType string, FilingDate string, DocID string>>"
_FACTS = """units struct<USD array<struct<start string, end string, val double, filed string, form string, accn string>>>"""
_SUBMISSIONS = "struct<form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>>"


def _xml(text: str, schema: str) -> Column:
    """XML text to a struct; namespaces are ignored and a broken document becomes null."""
    return F.from_xml(F.col(text), schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def _int(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("bigint")


def holdings_rows(docs: DataFrame, text: str = "xml") -> DataFrame:
    """(document columns, cusip, issuer, shares_held, value_usd_thousands) for share-type rows."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.explode(_xml(text, _HOLDINGS)["infoTable"]).alias("h"))
    return rows.where(F.trim("h.shrsOrPrnAmt.sshPrnamtType") == "SH").select(
        *keep, F.trim("h.cusip").alias("cusip"), F.col("h.nameOfIssuer").alias("issuer"),
        _int(F.col("h.shrsOrPrnAmt.sshPrnamt")).alias("shares_held"),
        _int(F.col("h.value")).alias("value_usd_thousands")).where(
        "cusip is not null and shares_held is not null and value_usd_thousands is not null")


def holdings(docs: DataFrame, securities: DataFrame, text: str = "xml") -> DataFrame:
    """Holdings of the watched securities; ``securities`` is (cusip, ticker)."""
    return holdings_rows(docs, text).drop("issuer").join(securities, "cusip")


def insider_transactions(docs: DataFrame, text: str = "xml") -> DataFrame:
    """Open-market purchases and sales of an ownership filing.

    ``docs`` carries ticker and filed_date. The first owner names the insider; without a title the
    first set role flag names it. Parsing is most of the work, so a document where neither a code stands by itself
    between tags nor an entity, comment or CDATA section could make one is left out before it: it has no such row.
    """
    plain = reduce(or_, [F.contains(F.col(text), F.lit(x)) for x in [*(f">{code}<" for code in OPEN_MARKET_CODES), "&", "<!"]])
    coded = plain | F.col(text).rlike(rf">[\x00-\x20]*(?:{'|'.join(OPEN_MARKET_CODES)})[\x00-\x20]*<")
    parsed = docs.where(coded).select("ticker", "filed_date", _xml(text, _OWNERSHIP).alias("x"))
    owner = F.try_element_at(F.col("x.reportingOwner"), F.lit(1))
    role = owner["reportingOwnerRelationship"]
    flag = lambda c: F.trim(role[c]) == "1"
    title = F.coalesce(
        F.nullif(F.trim(role["officerTitle"]), F.lit("")),
        F.when(flag("isDirector"), "Director").when(flag("isOfficer"), "Officer")
        .when(flag("isTenPercentOwner"), "TenPercentOwner"), F.lit(""))
    rows = parsed.select("ticker", "filed_date", F.coalesce(F.trim(owner["reportingOwnerId"]["rptOwnerName"]), F.lit("")).alias("insider_name"),
                         title.alias("insider_title"),
                         F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    rows = rows.select(
        "ticker", "filed_date", parse_day(F.trim("t.transactionDate.value")).alias("transaction_date"),
        "insider_name", "insider_title", F.trim("t.transactionCoding.transactionCode").alias("transaction_code"),
        F.trim("t.transactionAmounts.transactionShares.value").try_cast("double").alias("shares"),
        F.trim("t.transactionAmounts.transactionPricePerShare.value").try_cast("double").alias("price_per_share"))
    return rows.where(F.col("transaction_code").isin(OPEN_MARKET_CODES) & F.col("transaction_date").isNotNull()
                      & F.col("shares").isNotNull() & F.col("price_per_share").isNotNull()).withColumn(
        "value", F.col("shares") * F.col("price_per_share"))


def filing_index(lines: DataFrame, form: str = "13F-HR", text: str = "value") -> DataFrame:
    """Index lines split on two or more spaces: (cik, date_filed, filename) of one form type."""
    parts = F.split(F.trim(text), " {2,}")
    rows = lines.where(F.contains(F.col(text), F.lit(form))).select(parts.alias("p")).where(F.size("p") >= 5)
    at = lambda i: F.trim(F.col("p")[i])
    return rows.where(at(1) == form).select(
        F.when(F.length(at(2)) >= 10, at(2)).otherwise(F.lpad(at(2), 10, "0")).alias("cik"),
        at(3).alias("date_filed"), at(4).alias("filename"))


#: Fixed value: type and date of a disclosed trade.
TRADE = r"(?<!\w)([PS])\s*(?:\(partial\))?\s+(\d{2}/\d{2}/\d{4})"


def disclosure_trades(docs: DataFrame, watchlist: DataFrame, text: str = "text") -> DataFrame:
    """Trades in disclosure text: ticker in parentheses, type and date on the same or the three lines before.

    ``docs`` is (doc_id, politician_name, text). The line context is sliced from the document's own line
    array, so no shuffle is needed before the final one-per-(ticker, date, type) step.
    """
    kind = TRADE
    lines = docs.withColumn("_lines", F.split(text, "\n"))
    rows = lines.select("doc_id", "politician_name", "_lines", F.posexplode("_lines").alias("_i", "_line"))
    rows = rows.withColumn("ticker", F.regexp_extract("_line", r"\(([A-Z]{1,5})\)", 1)).where("ticker <> ''")
    rows = rows.join(watchlist.select("ticker").distinct(), "ticker", "left_semi")
    first = F.greatest(F.col("_i") - 2, F.lit(1))
    context = F.array_join(F.slice("_lines", first, F.col("_i") + 1 - first + 1), " ")
    rows = rows.withColumn("_ctx", context).drop("_lines")
    where = F.when(F.col("_line").rlike(kind), F.col("_line")).otherwise(F.col("_ctx"))
    rows = rows.withColumn("_type", F.regexp_extract(where, kind, 1)).withColumn(
        "trade_date", parse_day(F.regexp_extract(where, kind, 2), "MM/dd/yyyy")).where("trade_date is not null")
    money = F.transform(F.regexp_extract_all("_ctx", F.lit(r"\$([\d,]+)"), 1),
                        lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    pair = F.sort_array(F.slice(money, -2, 2))
    low = F.when(F.size(money) >= 2, F.try_element_at(pair, F.lit(1))).when(F.size(money) == 1, money[0]).otherwise(0.0)
    high = F.when(F.size(money) >= 2, F.try_element_at(pair, F.lit(2))).when(F.size(money) == 1, money[0]).otherwise(0.0)
    rows = rows.select(
        "doc_id", "ticker", "trade_date", F.when(F.col("_type") == "P", "purchase").otherwise("sale").alias("transaction_type"),
        F.struct("_i", low.alias("lo"), high.alias("hi"), "politician_name").alias("_row"))
    one = rows.groupBy("doc_id", "ticker", "trade_date", "transaction_type").agg(F.min("_row").alias("r"))
    return one.select("doc_id", "ticker", "trade_date", F.col("r.politician_name").alias("politician_name"),
                      F.lit("house").alias("chamber"), F.lit("").alias("party"), "transaction_type",
                      F.col("r.lo").alias("amount_low"), F.col("r.hi").alias("amount_high"),
                      ((F.col("r.lo") + F.col("r.hi")) / 2).alias("amount_mid"))


def fact_rows(docs: DataFrame, text: str = "json") -> DataFrame:
    """Concept documents to value rows of the periodic report forms."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.explode(F.from_json(text, _FACTS)["units"]["USD"]).alias("f"))
    return rows.where(F.col("f.form").isin(FACT_FORMS)).select(
        *keep, parse_day("f.start").alias("start"), parse_day("f.end").alias("end"), F.col("f.val").alias("val"),
        parse_day("f.filed").alias("filed"), F.col("f.form").alias("form"), F.col("f.accn").alias("accn"))


def submissions(docs: DataFrame, form: str, cutoff: Column | None = None, suffix: str = "", text: str = "json") -> DataFrame:
    """Parallel-array filing lists to (…, accession, filed, primary_doc) of one form, on or after the cutoff.

    ``cutoff`` is a date expression, e.g. ``F.greatest(lookback, since)``; null means no bound.
    """
    keep = [c for c in docs.columns if c != text]
    block = F.from_json(text, _SUBMISSIONS)
    rows = docs.select(*keep, F.explode(F.arrays_zip(
        block["form"].alias("form"), block["accessionNumber"].alias("accession"),
        block["filingDate"].alias("filed"), block["primaryDocument"].alias("primary_doc"))).alias("f"))
    rows = rows.where((F.col("f.form") == form) & (F.coalesce(F.col("f.primary_doc"), F.lit("")) != "")
                      & F.endswith(F.col("f.primary_doc"), F.lit(suffix)))
    out = rows.select(*keep, F.regexp_replace("f.accession", "-", "").alias("accession"),
                      parse_day("f.filed").alias("filed"), F.col("f.primary_doc").alias("primary_doc"))
    return out if cutoff is None else out.where(cutoff.isNull() | (F.col("filed") >= cutoff))


def cutoff_date(run_date: str, lookback_years: int | None, since: Column | None) -> Column | None:
    """The later of the two bounds; null bounds are ignored."""
    bounds = []
    if lookback_years:
        bounds.append(F.date_sub(F.lit(run_date).cast("date"), 365 * lookback_years))
    if since is not None:
        bounds.append(since)
    if not bounds:
        return None
    return bounds[0] if len(bounds) == 1 else F.greatest(*bounds)


def report_index(docs: DataFrame, run_date: str, days_back: int, kind: str = "P", text: str = "xml") -> DataFrame:
    """Members of a filing index of one type, filed inside the lookback."""
    rows = docs.select(F.explode(_xml(text, _MEMBERS)["Member"]).alias("m")).where(F.col("m.FilingType") == kind)
    out = rows.select(F.col("m.Last").alias("last"), F.col("m.First").alias("first"),
                      parse_day("m.FilingDate", "M/d/yyyy").alias("filing_date"), F.col("m.DocID").cast("string").alias("doc_id"))
    return out.where(F.col("filing_date") >= F.date_sub(F.lit(run_date).cast("date"), days_back))


def latest_filing(filings: DataFrame, key: str, form: str | None = None, on: str = "date_filed",
                  value: str = "filename") -> DataFrame:
    """Newest filing per entity (of one form); ties go to the larger file name."""
    if form is not None:
        filings = filings.where(F.col("form") == form)
    return filings.groupBy(key).agg(F.max(F.struct(on, value)).alias("_f")).select(
        key, F.col(f"_f.{on}").alias(on), F.col(f"_f.{value}").alias(value))


def top_filers(index: DataFrame, prior: DataFrame | None, n: int) -> DataFrame:
    """Filers by prior-period value, unseen ones after them by numeric id; (cik, total_value), first n."""
    ids = index.select("cik").distinct()
    if prior is None:
        return ids.withColumn("total_value", F.lit(None).cast("long")).orderBy(F.col("cik").cast("long")).limit(n)
    totals = prior.groupBy("cik").agg(F.sum("value_usd_thousands").alias("total_value"))
    return ids.join(totals, "cik", "left").orderBy(F.col("total_value").desc_nulls_last(), F.col("cik").cast("long")).limit(n)


def audit_ids(ours: DataFrame, theirs: DataFrame, filings: DataFrame, threshold_days: int = 30) -> DataFrame:
    """Compare our entity ids with the authority's and the newest filing under each.

    ``ours`` is (ticker, cik, reachable), ``theirs`` (ticker, cik), ``filings`` (cik, filed).
    """
    newest = filings.groupBy("cik").agg(F.max("filed").alias("filed"))
    mine = newest.select(F.col("cik").alias("our_cik"), F.col("filed").alias("our_latest"))
    other = newest.select(F.col("cik").alias("sec_cik"), F.col("filed").alias("sec_latest"))
    df = (ours.withColumnRenamed("cik", "our_cik").join(theirs.withColumnRenamed("cik", "sec_cik"), "ticker", "left")
          .join(mine, "our_cik", "left").join(other, "sec_cik", "left"))
    differs = F.col("sec_cik").isNotNull() & (F.col("sec_cik") != F.col("our_cik"))
    df = df.withColumn("sec_latest", F.when(differs, F.col("sec_latest")))
    gap = F.date_diff("sec_latest", "our_latest")
    severity = (F.when(~F.col("reachable"), "broken")
                .when(F.col("our_latest").isNull() & F.col("sec_latest").isNotNull(), "stale")
                .when(gap > threshold_days, "stale").when(gap > 0, "minor").when(differs, "minor").otherwise("ok"))
    return df.withColumn("severity", severity).withColumn(
        "suggested_cik", F.when(F.col("severity").isin("broken", "stale"), F.col("sec_cik"))).select(
        "ticker", "our_cik", "sec_cik", "our_latest", "sec_latest", "severity", "suggested_cik")
