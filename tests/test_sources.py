import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from tidespine.functions.text import amount_band, buyer_type, cpc_bucket, deal_mw, deal_type, mention_sentence, strip_markup
from tidespine.plans.deals import text_deals
from tidespine.plans.filings import period_facts, statements
from tidespine.schemas import TABLES, empty
from tidespine.session import scratch_path
from tidespine.sources import feeds, filings as sf, readers as rd, sinks as sk


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first()["y"]


def test_text_facts(spark):
    assert one(spark, "Power Purchase Agreement signed", deal_type) == "power_purchase_agreement"
    assert one(spark, "nothing", deal_type) == "customer_contract" and one(spark, "Duke Energy", buyer_type) == "utility"
    assert one(spark, "for 1.5 GW and 300 MW", deal_mw) == 1500.0 and one(spark, "500 megawatts", deal_mw) == 500.0 and one(spark, "none", deal_mw) is None
    assert one(spark, "$15,001 - $50,000", amount_band) == 32500.5 and one(spark, "Over $1,000,000", amount_band) == 1_500_000.0
    assert one(spark, "$250", amount_band) == 250.0 and one(spark, "n/a", amount_band) is None
    assert [one(spark, x, cpc_bucket) for x in ("G05D1/02", "G05D11", "B25J9/02", "B25JX", "B64U", "H01L")] == ["G05D1", None, "B25J", None, "B64", None]
    assert one(spark, "<p>A&nbsp;b</p>\n <i>c</i>", strip_markup) == "A b c"
    assert one(spark, "First. Then Acme came! End.", lambda x: mention_sentence(x, F.lit("acme"))) == "Then Acme came"


def test_agreement_text_to_deals(spark):
    text = "Item 1.01 Entry. Talen Energy signed a power purchase agreement with Amazon Web Services for 500 megawatts."
    docs = spark.createDataFrame([(1, "TLN", day(0), "u", text), (2, "TLN", day(0), "u", "quarterly results of Amazon")],
                                 "filing_id int, filer_ticker string, date date, url string, text string")
    names = spark.createDataFrame([("amazon", "AMZN", 0), ("amazon web services", "AMZN", 1), ("talen energy", "TLN", 2)], "company_name string, ticker string, ord int")
    got = text_deals(docs, names).collect()
    assert [(r["party_b"], r["deal_type"], r["deal_mw"], r["buyer_type"], r["confidence"]) for r in got] == [("AMZN", "power_purchase_agreement", 500.0, "hyperscaler", 0.7)]


def test_a_filing_is_classified_once_and_without_patterns(spark):
    text = "The Wafer SUPPLY Agreement and a license agreement. Acme, Beta and Filer sign for 2 GW."
    docs = spark.createDataFrame([(1, "F", day(0), "u", text), (2, "F", day(0), "v", "Filer alone: a joint venture"), (3, "F", day(0), "w", None)],
                                 "filing_id int, filer_ticker string, date date, url string, text string")
    names = spark.createDataFrame([("acme", "A", 0), ("beta", "B", 1), ("filer", "F", 2)], "company_name string, ticker string, ord int")
    out = text_deals(docs, names)
    got = sorted((r["filing_id"], r["party_b"], r["deal_type"], r["deal_mw"], r["description"]) for r in out.collect())
    assert got == [(1, p, "supply_agreement", 2000.0, "Acme, Beta and Filer sign for 2 GW") for p in "AB"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(")]  # what runs for each counterparty
    assert "wafer" not in above and "RLIKE" not in plan and "megawatt" not in above


XML = """<ownershipDocument{ns}><reportingOwner><reportingOwnerId><rptOwnerName>Jane Doe</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{rows}</nonDerivativeTable></ownershipDocument>"""
ROW = """<nonDerivativeTransaction><transactionDate><value>2024-01-05</value></transactionDate><transactionCoding><transactionCode>{c}</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>{s}</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"""


@pytest.mark.parametrize("ns", ["", ' xmlns="http://www.example.org/o"'])
def test_insider_xml(spark, ns):
    xml = XML.format(ns=ns, rows=ROW.format(c="P", s="100") + ROW.format(c="A", s="5") + ROW.format(c="S", s="bad"))
    docs = spark.createDataFrame([("T", day(6), xml), ("T", day(6), "<broken")], "ticker string, filed_date date, xml string")
    got = sf.insider_transactions(docs).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["insider_name"], r["insider_title"], r["transaction_code"], r["shares"], r["value"]) == ("Jane Doe", "Director", "P", 100.0, 250.0)


def test_holdings_xml(spark):
    row = "<infoTable><nameOfIssuer>N</nameOfIssuer><cusip>{c}</cusip><value>1,200</value><shrsOrPrnAmt><sshPrnamt>{s}</sshPrnamt><sshPrnamtType>{k}</sshPrnamtType></shrsOrPrnAmt></infoTable>"
    xml = '<informationTable xmlns="http://x">' + row.format(c="AAA", s="10", k="SH") + row.format(c="AAA", s="10", k="PRN") + row.format(c="BBB", s="1", k="SH") + "</informationTable>"
    docs = spark.createDataFrame([("c", xml)], "cik string, xml string")
    got = sf.holdings(docs, spark.createDataFrame([("AAA", "T")], "cusip string, ticker string")).collect()
    assert [(r["ticker"], r["shares_held"], r["value_usd_thousands"]) for r in got] == [("T", 10, 1200)]
    assert sf.holdings_rows(docs).count() == 2


def test_disclosure_text(spark):
    text = "Header\nNVIDIA Corp (NVDA) P 01/05/2024 $1,001 - $15,000\nNVIDIA Corp (NVDA) P 01/05/2024 $1,001 - $15,000\n\nS (partial) 01/06/2024 $500\nApple\nInc (AAPL)\n\n\n\n(MSFT) no trade\nXS 01/01/2024 (GOOG)"
    docs = spark.createDataFrame([(1, "P. Person", text)], "doc_id int, politician_name string, text string")
    watch = spark.createDataFrame([(t,) for t in ("NVDA", "AAPL", "MSFT", "GOOG")], "ticker string")
    got = by_key(sf.disclosure_trades(docs, watch), "ticker")
    assert set(got) == {"NVDA", "AAPL"}
    assert (got["NVDA"]["transaction_type"], got["NVDA"]["amount_mid"]) == ("purchase", 8000.5)
    assert got["AAPL"]["transaction_type"] == "sale" and got["AAPL"]["trade_date"] == day(5) and got["AAPL"]["amount_low"] == 500.0


def test_index_lines_and_top_filers(spark):
    lines = spark.createDataFrame([("BIG FUND LP    13F-HR    42  2024-02-14   edgar/a.txt  ",), ("X    13F-HR/A    1  2024-01-01  f",), ("13F-HR only",)], "value string")
    assert [tuple(r) for r in sf.filing_index(lines).collect()] == [("0000000042", "2024-02-14", "edgar/a.txt")]
    index = spark.createDataFrame([("0000000009",), ("0000000002",), ("0000000005",)], "cik string")
    prior = spark.createDataFrame([("0000000005", 10), ("0000000007", 99)], "cik string, value_usd_thousands long")
    assert [r["cik"] for r in sf.top_filers(index, prior, 2).collect()] == ["0000000005", "0000000002"]
    assert [r["cik"] for r in sf.top_filers(index, None, 2).collect()] == ["0000000002", "0000000005"]


def test_facts(spark):
    f = [("T", "Revenues", day(0), day(90), 1.0, day(100), "10-Q"), ("T", "Revenues", day(0), day(90), 2.0, day(200), "10-Q"), ("T", "Revenues", day(0), day(106), 3.0, day(200), "10-Q")]
    facts = spark.createDataFrame(f, "ticker string, concept string, start date, end date, val double, filed date, form string")
    assert [r["val"] for r in period_facts(facts, 75, 105).collect()] == [2.0]
    more = spark.createDataFrame([("T", "StockholdersEquity", None, day(90), 7.0, day(100), "10-Q"), ("T", "ProfitLoss", day(0), day(90), 5.0, day(100), "10-Q"),
                                  ("T", "PaymentsToAcquireProductiveAssets", day(0), day(90), -4.0, day(100), "10-Q")], facts.schema)
    r = statements(facts.unionByName(more)).collect()
    assert len(r) == 1 and (r[0]["revenue"], r[0]["equity"], r[0]["net_income"], r[0]["capex"]) == (2.0, 7.0, 5.0, 4.0)


def test_queue_headers(spark):
    assert feeds.canonical_columns(["q_date", "Queue Date", "Project", "junk"]) == {"queue_date": "q_date", "project_name": "Project"}
    raw = spark.createDataFrame([("45292", "P1", "x", " va "), ("2024-01-02", None, "5", "CA")], ["Queue Date", "Project Name", "MW", "State"])
    got = feeds.queue_rows(raw, "2024-02-01", ["VA"]).collect()
    assert [(r["queue_date"], r["mw"], r["state"], r["status"]) for r in got] == [(day(0), 0.0, "VA", "")]


def test_schemas_and_absent_tables(spark):
    for name in TABLES:
        assert empty(spark, name).count() == 0
    assert rd.scan(spark, scratch_path(spark, "none"), "ohlcv").columns[0] == "ticker"
    assert rd.read_csv_table(spark, scratch_path(spark, "none"), "deals").count() == 0


def test_upsert_guard_and_partitions(spark):
    path = scratch_path(spark, "t")
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, part string")
    sk.upsert_table(spark, path, make([(1, "a", "x"), (2, "b", "y"), (5, "e", "y")]), ["k"], "part")
    files = lambda part: {r[0] for r in spark.read.format("binaryFile").load(f"{path}/part={part}/*.parquet").select("path").collect()}
    untouched, old = files("x"), files("y")
    sk.upsert_table(spark, path, make([(2, "c", "y"), (3, "d", "z")]), ["k"], "part")
    assert sorted((r["k"], r["v"], r["part"]) for r in spark.read.parquet(path).collect()) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z"), (5, "e", "y")]
    assert files("x") == untouched and not files("y") & old
    assert {r[0] for r in rd.partition_values(spark, path, "part").collect()} == {"x", "y", "z"} and rd.partition_values(spark, path + "-none").count() == 0
    parts = scratch_path(spark, "p")
    dated = lambda v, *ds: spark.createDataFrame([(v, day(x)) for x in ds], "v string, date date")
    sk.write_dates(dated("old", 0, 1), parts)
    sk.write_dates(dated("new", 1), parts)
    assert {(r["v"], r["date"]) for r in spark.read.parquet(parts).collect()} == {("old", day(0)), ("new", day(1))}
    assert rd.latest_partition(spark, parts).collect()[0]["v"] == "new"
    wanted = dated("w", 0, 6, 7, 31)
    assert {r["date"] for r in sk.missing_snapshots(wanted, dated("h", 1), "week").collect()} == {day(7), day(31)}
    assert {r["date"] for r in sk.missing_snapshots(wanted, dated("h", 1), "month").collect()} == {day(31)}
    assert sk.missing_snapshots(wanted, dated("h", 100), "half_year").count() == 0


def test_horizon_tags_stay_text(spark):
    path = scratch_path(spark, "h")
    sk.write_by(spark.createDataFrame([(1, "5d"), (2, "20d")], "x int, horizon string"), path, "horizon")
    assert {r["horizon"] for r in rd.read_partitions(spark, path, "x int, horizon string").collect()} == {"5d", "20d"}


def test_insider_documents_without_codes_are_not_parsed(spark):
    from tidespine.sources import filings

    def xml(code):
        return ("<ns:ownershipDocument xmlns:ns='http://x.org/o'><ns:nonDerivativeTable><ns:nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate>"
                f"<transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>2</value></transactionShares>"
                "<transactionPricePerShare><value>3</value></transactionPricePerShare></transactionAmounts></ns:nonDerivativeTransaction></ns:nonDerivativeTable></ns:ownershipDocument>")

    codes = ["P", "S", " P ", "\n\tS\r\n", "<![CDATA[P]]>", "&#80;", "<!-- bought -->P", "S<!-- sold -->", "G", "PS", "P S", "", "X"]
    docs = spark.createDataFrame([(f"T{i}", day(0), xml(code)) for i, code in enumerate(codes)] + [("T99", day(0), "no xml"), ("T98", day(0), None)], "ticker string, filed_date date, xml string")
    got = filings.insider_transactions(docs)
    assert sorted(r["ticker"] for r in got.collect()) == sorted(f"T{i}" for i in range(8))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" in plan.split("RLIKE")[0] and "from_xml" not in plan.split("RLIKE")[1]


def test_deals_get_their_names_after_the_large_join(spark):
    from tidespine.catalog.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines = t.deal_lines
    assert not {"n_name", "ticker", "party_a", "party_b"} & set(lines.columns) and lines.count() == t.deals.count() == t.raw("lineitem").count()
    keys = lines.select("day", "c_nationkey", "s_nationkey").distinct()
    assert sorted(map(tuple, t.deal_parties(keys).select("day", "party_a", "party_b").collect())) == sorted(map(tuple, t.deals.select("date", "party_a", "party_b").distinct().collect()))


def test_stored_views_are_packed_and_families_stored_apart(spark):
    import datetime as dt

    from tidespine.catalog.views import Tables
    from tidespine.plans import dataset as ds, market as mk, price
    from tidespine.session import while_storing

    views = Tables(spark, "/nowhere")
    views.deals = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "B", "licensing_agreement", 0.5)] * 3 + [(None, None, "B", None, None)], "date date, party_a string, party_b string, deal_type string, confidence double")
    views.store("deals")
    kept = views.stored("deals")
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.schema.simpleString() == views.deals.schema.simpleString() and sorted(map(str, kept.collect())) == sorted(map(str, views.deals.collect()))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with while_storing(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before

    px = [(t, dt.date(2024, 1, 1) + dt.timedelta(i), 100.0 + i * k, 10 + i % 7) for k, t in enumerate("ABC") for i in range(60)]
    px = spark.createDataFrame([(*r[:2], None if i % 50 == 7 else r[2], r[3]) for i, r in enumerate(px)], "ticker string, date date, close_price double, volume long")
    layers = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "ticker string, layer string")
    trades = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(i), "N", "P", 5.0) for i in range(40)], "ticker string, transaction_date date, insider_name string, transaction_code string, value double")
    congress = spark.createDataFrame([("B", dt.date(2024, 1, 20), "purchase", 3.0)], "ticker string, trade_date date, transaction_type string, amount_mid double")
    threats = spark.createDataFrame([(dt.date(2024, 1, 9), "cve_critical", 2.0)], "date date, metric string, value double")
    src = ds.Sources(px, layers, mk.correlation_peers(layers), {"insider_trades": trades, "congress_trades": congress, "threats": threats})
    got = ds.training_datasets(src, ["5d", "20d"])
    assert "family-" not in got["5d"]._jdf.queryExecution().executedPlan().toString() and price.HORIZONS["5d"] == 5
    for h, df in got.items():
        want = ds.training_dataset(src, horizon=h)
        assert df.columns == want.columns and df.dtypes == want.dtypes
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.count() > 0
