"""The driver's tables seen as the source tables of the library: Spark builders and their SQL twins.

Sums run on decimals and become doubles once, so both engines get the same bits.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidespine.functions.dates import quarter_end, quarter_label
from tidespine.operators.recent import together
from tidespine.session import stored, while_storing

MONEY = "decimal(18,2)"

# How the test tables' codes stand in for source codes.
METRIC_OF_EVENT = {"click": "cve_high", "view": "otx_pulse", "purchase": "cisa_kev", "error": "cve_critical"}
SERIES_OF_PART = ["NEWORDER", "CFNAI", "IPG3331S", "WPU114", "JTS333000000000000JOL", "B25J", "B64", "B60W",
                  "G05D1", "G05B19", "G06V"]
DEAL_OF_LINE = {1: "power_purchase_agreement", 2: "supply_agreement", 3: "manufacturing_agreement",
                4: "customer_contract", 5: "joint_venture"}
BUYER_OF_SEGMENT = {"AUTOMOBILE": "hyperscaler", "BUILDING": "utility", "FURNITURE": "crypto_miner"}
CODE_OF_LINE = {1: "8541", 2: "8542", 3: "8471", 4: "8473"}
CLASS_OF_LINE = {1: "G06N", 2: "H01L", 3: "B25J9/02", 4: "G05D1/02", 5: "B64C39/00", 6: "G06V10/10"}
STATES = ["VA", "TX", "NY", "OH", "CA", "AZ", "FL", "GA", "WA", "ME"]
COUNTRIES = ["United States", "Canada", "Germany", "United Kingdom", "France", "Netherlands", "Norway", "Sweden",
             "Iceland", "Japan", "South Korea", "Singapore", "Malaysia"]
REGION_OF_SEGMENT = {"AUTOMOBILE": "north_america", "BUILDING": "emea", "FURNITURE": "nordics",
                     "HOUSEHOLD": "asia_pacific"}
AGREEMENT_WORDS = ["offtake agreement", "supply contract", "foundry agreement", "cloud agreement", "epc agreement",
                   "joint venture", "equity investment", "license agreement", "memorandum"]
NAICS_OF_LINE = {1: "541511", 2: "334413", 3: "518210"}


def case_sql(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def case_col(c: Column, mapping: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def dsum(c: Column, kind: str = MONEY) -> Column:
    """Exact decimal sum as double."""
    return F.sum(c.cast(kind)).cast("double")


class Tables:
    """The given tables and the source-table views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A view written once to the shared folder, like the stored source table it stands for.

        Used where one query reads the view many times; plain views suit single reads.
        """
        if name not in self._stored:
            self._stored[name] = stored(getattr(self, name), name)
        return self._stored[name]

    def store(self, *names: str) -> None:
        """Several views stored side by side."""
        todo = {name: getattr(self, name) for name in names if name not in self._stored}
        with while_storing(self.spark):
            self._stored |= together({name: (lambda name=name, df=df: stored(df, name)) for name, df in todo.items()}) if todo else {}

    @cached_property
    def nat(self):
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("layer"))

    @cached_property
    def layers(self):
        return self.nat.select("ticker", "layer")

    @cached_property
    def ord(self):
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            self.nat, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "ticker", "layer", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_custkey", "c_name", "c_mktsegment",
            "o_orderstatus", "o_orderpriority", "o_totalprice")

    @cached_property
    def px(self):
        return self.ord.groupBy("ticker", F.col("day").alias("date")).agg(
            (dsum(F.col("o_totalprice")) / F.count(F.lit(1))).alias("close_price"),
            F.count(F.lit(1)).alias("volume"))

    @cached_property
    def li(self):
        return self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "ticker", "layer", F.to_date("l_shipdate").alias("day"), "s_name", "l_orderkey", "l_partkey", "l_suppkey",
            "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

    @cached_property
    def tr(self):
        return self.li.select(
            "ticker", F.col("day").alias("transaction_date"), F.col("s_name").alias("insider_name"),
            case_col(F.col("l_returnflag"), {"R": "P", "A": "S", "N": "G"}).alias("transaction_code"),
            F.col("l_extendedprice").cast(MONEY).alias("value"))

    @cached_property
    def cg(self):
        return self.ord.select(
            "ticker", F.col("day").alias("trade_date"),
            case_col(F.col("o_orderstatus"), {"F": "purchase", "O": "sale", "P": "exchange"}).alias("transaction_type"),
            F.col("o_totalprice").cast(MONEY).alias("amount_mid"))

    @cached_property
    def si(self):
        return self.li.groupBy("ticker", F.col("day").alias("date")).agg(
            (dsum(F.col("l_quantity") * F.col("l_discount"), "decimal(18,4)")
             / dsum(F.col("l_quantity"))).alias("short_vol_ratio"))

    @cached_property
    def er(self):
        q = self.li.groupBy("ticker", quarter_end("day").alias("quarter_end")).agg(
            F.round(dsum(F.col("l_extendedprice")) / dsum(F.col("l_quantity")), 6).alias("eps_actual"))
        est = F.lag("eps_actual").over(Window.partitionBy("ticker").orderBy("quarter_end"))
        diff = F.col("eps_actual") - F.col("eps_estimate")
        return q.withColumn("eps_estimate", est).withColumn("eps_surprise", diff).withColumn(
            "eps_surprise_pct", F.when(F.abs("eps_estimate") > 1e-9, diff / F.abs("eps_estimate")))

    @cached_property
    def fq(self):
        p, q = F.col("l_extendedprice"), F.col("l_quantity")
        flag = F.col("l_returnflag")
        part = lambda cond: F.coalesce(dsum(F.when(cond, p)), F.lit(0.0))
        return self.li.groupBy("ticker", quarter_end("day").alias("period_end")).agg(
            dsum(p).alias("revenue"), part(flag != "A").alias("gross_profit"), part(flag == "R").alias("operating_income"),
            (part(flag == "R") - part(flag == "A")).alias("net_income"),
            dsum(p * F.col("l_tax"), "decimal(18,4)").alias("capex"),
            dsum(F.when(F.col("l_linenumber") == 1, p)).alias("rd_expense"),
            part(F.col("l_linestatus") == "O").alias("equity"), part(flag == "N").alias("long_term_debt"),
            dsum(q).alias("current_assets"), dsum(F.when(flag == "R", q)).alias("current_liabilities"),
            F.count(F.lit(1)).cast("double").alias("shares_outstanding"))

    @cached_property
    def hq(self):
        return self.fq.select("ticker", "period_end", "revenue", "capex")

    @cached_property
    def hold(self):
        o = self.raw("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
        p = self.raw("part").select("p_partkey", "p_brand")
        return self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(
            p, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("o_custkey").alias("cik"), F.col("p_brand").alias("ticker"), quarter_label("day").alias("quarter"),
            quarter_end("day").alias("period_end"), F.col("l_quantity").cast("long").alias("shares_held"))

    @cached_property
    def shares(self):
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
            F.col("p_brand").alias("ticker")).agg(F.sum(F.col("l_quantity").cast("long")).alias("shares_outstanding"))

    @cached_property
    def bpx(self):
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
            F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
            (dsum(F.col("l_extendedprice")) / F.count(F.lit(1))).alias("close_price"))

    @cached_property
    def ev(self):
        return self.raw("events").withColumn("day", F.to_date("ts"))

    @cached_property
    def evspine(self):
        return self.ev.select(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("ticker"),
                              F.col("day").alias("date")).distinct()

    @cached_property
    def threats(self):
        metric = case_col(F.col("event_type"), METRIC_OF_EVENT)
        return self.ev.select(F.col("day").alias("date"), metric.alias("metric"),
                              F.col("value").cast(MONEY).cast("double").alias("value")).where("metric is not null")

    @cached_property
    def news(self):
        n = F.lit("NATION_")
        d = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        score = (F.col("quality") - F.col("toxic")).cast("double")
        label = F.when(score > 0, "positive").when(score < 0, "negative").when(score == 0, "neutral")
        return d.select(
            "doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("timestamp").alias("timestamp"),
            F.array_distinct(F.array(F.concat(n, (F.col("doc_id") % 25).cast("string")),
                                     F.concat(n, (F.col("n_chars") % 25).cast("string")))).alias("mentioned_tickers"),
            score.alias("net_sentiment"), label.alias("label"))

    @cached_property
    def obs(self):
        """Long macro series: monthly for the first five keys, quarter ends for the class counts."""
        l = self.raw("lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_partkey") % 11).cast("int").alias("k"),
                                        "l_extendedprice")
        key = F.element_at(F.array(*[F.lit(s) for s in SERIES_OF_PART]), F.col("k") + 1)
        at = F.when(F.col("k") < 5, F.trunc("day", "MM")).otherwise(quarter_end("day"))
        return l.groupBy(key.alias("series_id"), at.alias("date")).agg(dsum(F.col("l_extendedprice")).alias("value"))

    @cached_property
    def jolts(self):
        snap = F.when(F.col("l_linestatus") == "O", F.lit("2003-02-01")).otherwise("2003-01-01").cast("date")
        return self.li.groupBy(snap.alias("date"), F.year("day").alias("year"),
                               F.concat(F.lit("M"), F.lpad(F.month("day").cast("string"), 2, "0")).alias("period")).agg(
            F.count(F.lit(1)).cast("double").alias("value")).withColumn("series_id", F.lit("JTS510000000000000JOL"))

    @cached_property
    def trade(self):
        partner = F.when(F.col("l_suppkey") % 3 == 0, "5700").when(F.col("l_suppkey") % 3 == 1, "5830").otherwise("ALL")
        snap = F.when(F.col("l_linestatus") == "O", F.lit("2003-02-01")).otherwise("2003-01-01").cast("date")
        return self.li.groupBy(
            snap.alias("date"), F.when(F.col("l_returnflag") == "R", "export").otherwise("import").alias("direction"),
            case_col(F.col("l_linenumber"), CODE_OF_LINE, "9999").alias("hs_code"), partner.alias("partner_code"),
            F.year("day").alias("year"), F.month("day").alias("month")).agg(
            dsum(F.col("l_extendedprice")).alias("value_usd"))

    @cached_property
    def postings(self):
        """Events as postings restated over several snapshots: two events share one posting id."""
        return self.ev.select(F.col("day").alias("date"), F.floor(F.col("event_id") / 2).cast("string").alias("posting_id"),
                              F.date_sub("day", (F.col("user_id") % 20).cast("int")).alias("posted_date"),
                              F.col("event_type").alias("keyword"))

    @cached_property
    def deal_lines(self):
        """Deals by keys: the large join and what reduces it carry no names."""
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        o = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", F.to_date("o_orderdate").alias("day"), "c_nationkey", "c_mktsegment")
        return self.raw("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    def deal_parties(self, lines: DataFrame) -> DataFrame:
        """Rows with the two nations' keys, and their names as ``party_a`` and ``party_b``."""
        n = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("party_b"))
        return lines.join(n, "s_nationkey").join(self.nat.select(F.col("n_nationkey").alias("c_nationkey"), F.col("ticker").alias("party_a")), "c_nationkey")

    @cached_property
    def deals(self):
        return self.deal_parties(self.deal_lines).select(
            F.col("day").alias("date"), "party_a", "party_b",
            case_col(F.col("l_linenumber"), DEAL_OF_LINE, "licensing_agreement").alias("deal_type"),
            (F.lit(1.0) - F.col("l_discount")).alias("confidence"), F.col("l_quantity").alias("deal_mw"),
            case_col(F.col("c_mktsegment"), BUYER_OF_SEGMENT, "other").alias("buyer_type"))

    @cached_property
    def awards(self):
        return self.li.select(F.col("day").alias("date"), F.col("s_name").alias("awardee_name"),
                              F.col("l_suppkey").cast("string").alias("uei"),
                              F.col("l_extendedprice").cast(MONEY).cast("double").alias("contract_value_usd"),
                              case_col(F.col("l_linenumber"), NAICS_OF_LINE, "999999").alias("naics_code"),
                              F.col("l_returnflag").alias("agency"))

    @cached_property
    def award_names(self):
        return self.raw("supplier").join(self.nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_name").alias("awardee_name"), "ticker")

    @cached_property
    def queue(self):
        states = F.array(*[F.lit(s) for s in STATES])
        return self.li.select(
            F.date_add("day", F.col("l_linenumber") * 30).alias("snapshot_date"), F.col("day").alias("queue_date"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("project_name"), F.col("l_quantity").alias("mw"),
            F.element_at(states, (F.col("l_suppkey") % 10).cast("int") + 1).alias("state"))

    @cached_property
    def apps(self):
        return self.li.select(
            F.date_add("day", F.col("l_linenumber")).alias("date"), F.col("s_name").alias("assignee_name"),
            F.col("l_orderkey").alias("app_id"), case_col(F.col("l_linenumber"), CLASS_OF_LINE, "X").alias("cpc_group"),
            F.col("day").alias("filing_date"))

    @cached_property
    def grants(self):
        return self.li.select(
            F.date_add("day", F.col("l_linenumber")).alias("date"), F.col("s_name").alias("assignee_name"),
            F.col("l_partkey").alias("patent_id"), F.col("day").alias("grant_date"),
            F.col("l_quantity").cast("int").alias("forward_citation_count"))

    @cached_property
    def zones(self):
        zone = F.when(F.col("o_orderpriority") == "1-URGENT", "ALL_VIRGINIA").otherwise(F.col("o_orderpriority"))
        return self.ord.groupBy(zone.alias("zone"), F.trunc("day", "MM").alias("date")).agg(
            (dsum(F.col("o_totalprice")) / 1e6).alias("queue_backlog_gw"))

    @cached_property
    def capacity(self):
        fuel = F.when(F.col("l_linestatus") == "O", "nuclear").otherwise("natural_gas")
        return self.li.groupBy(fuel.alias("fuel_type"), quarter_end("day").alias("date")).agg(
            (dsum(F.col("l_quantity")) / 1e3).alias("capacity_gw"))

    @cached_property
    def energy(self):
        names = F.array(*[F.lit(c) for c in COUNTRIES])
        c = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return c.groupBy(F.element_at(names, F.col("c_nationkey") % 13 + 1).alias("country"),
                         F.year("o_orderdate").alias("year")).agg(
            F.round(dsum(F.col("c_acctbal")) / F.count(F.lit(1)) / 5e4, 6).alias("renewables_pct"),
            F.round(dsum(F.col("o_totalprice")) / F.count(F.lit(1)) / 6e2, 6).alias("carbon_intensity_gco2_per_kwh"))

    @cached_property
    def exposure(self):
        """Exposure by customer segment; entities whose name ends in 5 report none and use the default."""
        c = self.raw("customer").join(self.nat.where("ticker not like '%5'"), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.groupBy("ticker", case_col(F.col("c_mktsegment"), REGION_OF_SEGMENT, "other").alias("region")).agg(
            F.count(F.lit(1)).cast("double").alias("weight"))

    @cached_property
    def currencies(self):
        return self.nat.select("ticker", F.when(F.col("layer") == "AFRICA", "USD").otherwise(F.col("layer")).alias("currency"),
                               F.col("layer").alias("pair"))

    @cached_property
    def rates(self):
        return self.ord.groupBy(F.col("layer").alias("pair"), F.col("day").alias("date")).agg(
            (F.lit(1.0) + F.count(F.lit(1)) / 10.0).alias("rate"))

    @cached_property
    def options(self):
        month = F.trunc(F.to_date("l_shipdate"), "MM")
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("ticker"), month.alias("date"), F.date_add(month, F.col("l_linenumber") * 15).alias("expiry"),
            F.when(F.col("l_returnflag") == "N", "call").otherwise("put").alias("option_type"),
            F.col("p_retailprice").alias("strike"), F.col("l_discount").alias("iv"),
            F.col("l_quantity").cast("long").alias("oi"), (F.col("l_linenumber") * 10).cast("long").alias("volume"))

    @cached_property
    def positions(self):
        return self.ev.select(
            F.col("ts").alias("timestamp"), "day", F.col("user_id").alias("mmsi"), (F.col("user_id") % 120).cast("int").alias("vessel_type"),
            (F.col("event_id") % 60 - 10).cast("double").alias("latitude"),
            (F.col("user_id") * 7 % 180 - 40).cast("double").alias("longitude"))

    @cached_property
    def facts(self):
        """Reported facts: orders as periods of 0-119 days with three concepts of one measure."""
        concept = case_col(F.col("o_orderstatus"), {"F": "Revenues", "O": "SalesRevenueNet", "P": "GrossProfit"})
        return self.ord.select(
            "ticker", concept.alias("concept"), F.col("day").alias("start"),
            F.date_add("day", (F.col("o_custkey") % 120).cast("int")).alias("end"), F.col("o_totalprice").alias("val"),
            F.date_add("day", (F.col("o_custkey") % 7 + 120).cast("int")).alias("filed"), F.lit("10-Q").alias("form"))

    @cached_property
    def filing(self):
        """Agreement filings: each document's whole text plus one agreement sentence."""
        word = F.element_at(F.array(*[F.lit(w) for w in AGREEMENT_WORDS]), (F.col("doc_id") % len(AGREEMENT_WORDS)).cast("int") + 1)
        unit = F.when(F.col("doc_id") % 3 == 0, " gigawatt").otherwise(" MW")
        text = F.concat(F.col("text"), F.lit(" Item 1.01 entry. The "), word, F.lit(" with Nation_"),
                        (F.col("n_chars") % 25).cast("string"), F.lit(" Corp covers "), (F.col("n_chars") % 997).cast("string"),
                        unit, F.lit("! Terms follow."))
        return self.raw("documents").select(
            F.col("doc_id").alias("filing_id"), F.concat(F.lit("NATION_"), (F.col("doc_id") % 25).cast("string")).alias("filer_ticker"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
            F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), text.alias("text"))

    @cached_property
    def companies(self):
        """Company names of the entities with their dictionary order."""
        return self.nat.select(F.lower("ticker").alias("company_name"), "ticker", F.col("n_nationkey").alias("ord"))

    @cached_property
    def epx(self):
        """A second price panel whose days overlap the events and documents."""
        return self.ev.groupBy(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("ticker"),
                               F.col("day").alias("date")).agg(
            (dsum(F.col("value")) / F.count(F.lit(1))).alias("close_price"), F.count(F.lit(1)).alias("volume"))

    @cached_property
    def peers(self):
        """Correlation peers by the library's rule, from the registry of entities and groups."""
        from tidespine.plans.market import correlation_peers

        return correlation_peers(self.layers)

    @cached_property
    def preds(self):
        """Stand-in predictions for two horizons: recent returns as model outputs."""
        from tidespine.plans.price import price_features

        f = price_features(self.px)
        r = lambda c: F.round(c, 6)
        base = f.select("ticker", "date", r("sma_20_deviation").alias("expected_annual_return"),
                        r("return_1d").alias("lgbm_return"), r("return_5d").alias("rf_return"),
                        r("return_20d").alias("ridge_return"))
        return base.where("ridge_return is not null").withColumn("horizon", F.explode(F.array(F.lit("5d"), F.lit("20d"))))

    @cached_property
    def panel(self):
        """Predicted and realised 20-row returns with their group."""
        from tidespine.plans.price import labels_all, price_features

        f = price_features(self.px).select("ticker", "date", F.round("return_20d", 6).alias("predicted"))
        y = labels_all(self.px, {"20d": 20}).select("ticker", "date", F.round("label_return_20d", 6).alias("actual"))
        return f.join(y, ["ticker", "date"]).where("predicted is not null and actual is not null").join(self.layers, "ticker")


_QEND = "last_day(make_date(year({0})::INTEGER, (quarter({0}) * 3)::INTEGER, 1))"
_DAY = "CAST(l_shipdate AS DATE)"
_D = "DECIMAL(18,2)"

SQL_VIEWS: dict[str, str] = {
    "nat": "SELECT n_nationkey, n_name AS ticker, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ord": """SELECT ticker, layer, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_custkey, c_name, c_mktsegment, o_orderstatus,
              o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey""",
    "px": f"""SELECT ticker, day AS date, CAST(SUM(CAST(o_totalprice AS {_D})) AS DOUBLE) / COUNT(*) AS close_price,
              COUNT(*) AS volume FROM ord GROUP BY 1, 2""",
    "li": f"""SELECT ticker, layer, {_DAY} AS day, s_name, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey""",
    "tr": f"""SELECT ticker, day AS transaction_date, s_name AS insider_name,
              CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'A' THEN 'S' WHEN 'N' THEN 'G' END AS transaction_code,
              CAST(l_extendedprice AS {_D}) AS value FROM li""",
    "cg": f"""SELECT ticker, day AS trade_date, CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'sale'
              WHEN 'P' THEN 'exchange' END AS transaction_type, CAST(o_totalprice AS {_D}) AS amount_mid FROM ord""",
    "si": f"""SELECT ticker, day AS date, CAST(SUM(CAST(l_quantity * l_discount AS DECIMAL(18,4))) AS DOUBLE)
              / CAST(SUM(CAST(l_quantity AS {_D})) AS DOUBLE) AS short_vol_ratio FROM li GROUP BY 1, 2""",
    "er0": f"""SELECT ticker, {_QEND.format('day')} AS quarter_end, ROUND(CAST(SUM(CAST(l_extendedprice AS {_D})) AS DOUBLE)
              / CAST(SUM(CAST(l_quantity AS {_D})) AS DOUBLE), 6) AS eps_actual FROM li GROUP BY 1, 2""",
    "er": """SELECT *, eps_actual - eps_estimate AS eps_surprise,
             CASE WHEN abs(eps_estimate) > 1e-9 THEN (eps_actual - eps_estimate) / abs(eps_estimate) END AS eps_surprise_pct
             FROM (SELECT *, LAG(eps_actual) OVER (PARTITION BY ticker ORDER BY quarter_end) AS eps_estimate FROM er0)""",
    "fq": f"""SELECT ticker, {_QEND.format('day')} AS period_end, CAST(SUM(p) AS DOUBLE) AS revenue,
              COALESCE(CAST(SUM(p) FILTER (l_returnflag <> 'A') AS DOUBLE), 0.0) AS gross_profit,
              COALESCE(CAST(SUM(p) FILTER (l_returnflag = 'R') AS DOUBLE), 0.0) AS operating_income,
              COALESCE(CAST(SUM(p) FILTER (l_returnflag = 'R') AS DOUBLE), 0.0)
                - COALESCE(CAST(SUM(p) FILTER (l_returnflag = 'A') AS DOUBLE), 0.0) AS net_income,
              CAST(SUM(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS capex,
              CAST(SUM(p) FILTER (l_linenumber = 1) AS DOUBLE) AS rd_expense,
              COALESCE(CAST(SUM(p) FILTER (l_linestatus = 'O') AS DOUBLE), 0.0) AS equity,
              COALESCE(CAST(SUM(p) FILTER (l_returnflag = 'N') AS DOUBLE), 0.0) AS long_term_debt,
              CAST(SUM(q) AS DOUBLE) AS current_assets, CAST(SUM(q) FILTER (l_returnflag = 'R') AS DOUBLE) AS current_liabilities,
              CAST(COUNT(*) AS DOUBLE) AS shares_outstanding
              FROM (SELECT *, CAST(l_extendedprice AS {_D}) AS p, CAST(l_quantity AS {_D}) AS q FROM li) GROUP BY 1, 2""",
    "hq": "SELECT ticker, period_end, revenue, capex FROM fq",
    "hold": f"""SELECT o_custkey AS cik, p_brand AS ticker, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter,
              {_QEND.format('o_orderdate')} AS period_end, CAST(l_quantity AS BIGINT) AS shares_held
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "shares": """SELECT p_brand AS ticker, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares_outstanding
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "bpx": f"""SELECT p_brand AS ticker, {_DAY} AS date, CAST(SUM(CAST(l_extendedprice AS {_D})) AS DOUBLE) / COUNT(*) AS close_price
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "ev": "SELECT *, CAST(ts AS DATE) AS day FROM events",
    "evspine": "SELECT DISTINCT 'NATION_' || (user_id % 25)::VARCHAR AS ticker, day AS date FROM ev",
    "threats": f"""SELECT * FROM (SELECT day AS date, {case_sql('event_type', METRIC_OF_EVENT)} AS metric,
              CAST(CAST(value AS {_D}) AS DOUBLE) AS value FROM ev) WHERE metric IS NOT NULL""",
    "news": """SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day,
              list_distinct(['NATION_' || (doc_id % 25)::VARCHAR, 'NATION_' || (n_chars % 25)::VARCHAR]) AS mentioned_tickers,
              CAST(quality - toxic AS DOUBLE) AS net_sentiment, CASE WHEN quality - toxic > 0 THEN 'positive'
              WHEN quality - toxic < 0 THEN 'negative' WHEN quality - toxic = 0 THEN 'neutral' END AS label
              FROM documents LEFT JOIN labels USING (doc_id)""",
    "tagged": "SELECT day, UNNEST(mentioned_tickers) AS ticker, net_sentiment, label, doc_id FROM news",
    "obs": f"""SELECT series_id, date, CAST(SUM(CAST(l_extendedprice AS {_D})) AS DOUBLE) AS value FROM (
              SELECT {case_sql('l_partkey % 11', dict(enumerate(SERIES_OF_PART)))} AS series_id, CASE WHEN l_partkey % 11 < 5
              THEN CAST(date_trunc('month', {_DAY}) AS DATE) ELSE {_QEND.format(_DAY)} END AS date, l_extendedprice
              FROM lineitem) GROUP BY 1, 2""",
    "jolts": """SELECT CASE WHEN l_linestatus = 'O' THEN DATE '2003-02-01' ELSE DATE '2003-01-01' END AS date,
              CAST(year(day) AS INTEGER) AS year, 'M' || lpad(month(day)::VARCHAR, 2, '0') AS period, CAST(COUNT(*) AS DOUBLE) AS value,
              'JTS510000000000000JOL' AS series_id FROM li GROUP BY 1, 2, 3""",
    "trade": f"""SELECT CASE WHEN l_linestatus = 'O' THEN DATE '2003-02-01' ELSE DATE '2003-01-01' END AS date,
              CASE WHEN l_returnflag = 'R' THEN 'export' ELSE 'import' END AS direction,
              {case_sql('l_linenumber', CODE_OF_LINE, "'9999'")} AS hs_code,
              CASE l_suppkey % 3 WHEN 0 THEN '5700' WHEN 1 THEN '5830' ELSE 'ALL' END AS partner_code,
              CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
              CAST(SUM(CAST(l_extendedprice AS {_D})) AS DOUBLE) AS value_usd FROM li GROUP BY 1, 2, 3, 4, 5, 6""",
    "trade1": """SELECT direction, hs_code, partner_code, year, month, arg_max(value_usd, date) AS value_usd FROM trade GROUP BY 1, 2, 3, 4, 5""",
    "postings": """SELECT day AS date, (event_id // 2)::VARCHAR AS posting_id, day - CAST(user_id % 20 AS INTEGER) AS posted_date,
              event_type AS keyword FROM ev""",
    "postings1": """SELECT date, posting_id, posted_date, keyword FROM (SELECT *, row_number() OVER (PARTITION BY posting_id
              ORDER BY date DESC, posted_date DESC, keyword DESC) AS rn FROM postings) WHERE rn = 1""",
    "deals": f"""SELECT day AS date, ticker AS party_a, n_name AS party_b,
              {case_sql('l_linenumber', DEAL_OF_LINE, "'licensing_agreement'")} AS deal_type, 1.0::DOUBLE - l_discount AS confidence,
              l_quantity AS deal_mw, {case_sql('c_mktsegment', BUYER_OF_SEGMENT, "'other'")} AS buyer_type
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
              JOIN ord ON l_orderkey = o_orderkey""",
    "awards": f"""SELECT day AS date, s_name AS awardee_name, l_suppkey::VARCHAR AS uei,
              CAST(CAST(l_extendedprice AS {_D}) AS DOUBLE) AS contract_value_usd,
              {case_sql('l_linenumber', NAICS_OF_LINE, "'999999'")} AS naics_code, l_returnflag AS agency FROM li""",
    "award_names": "SELECT s_name AS awardee_name, ticker FROM supplier JOIN nat ON s_nationkey = n_nationkey",
    "queue": f"""SELECT day + l_linenumber * 30 AS snapshot_date, day AS queue_date, 'P' || l_partkey::VARCHAR AS project_name,
              l_quantity AS mw, {case_sql('l_suppkey % 10', dict(enumerate(STATES)))} AS state FROM li""",
    "apps": f"""SELECT day + l_linenumber AS date, s_name AS assignee_name, l_orderkey AS app_id,
              {case_sql('l_linenumber', CLASS_OF_LINE, "'X'")} AS cpc_group, day AS filing_date FROM li""",
    "grants": """SELECT day + l_linenumber AS date, s_name AS assignee_name, l_partkey AS patent_id, day AS grant_date,
              CAST(l_quantity AS INTEGER) AS forward_citation_count FROM li""",
    "zones": f"""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'ALL_VIRGINIA' ELSE o_orderpriority END AS zone,
              CAST(date_trunc('month', day) AS DATE) AS date, CAST(SUM(CAST(o_totalprice AS {_D})) AS DOUBLE) / 1e6 AS queue_backlog_gw
              FROM ord GROUP BY 1, 2""",
    "capacity": f"""SELECT CASE WHEN l_linestatus = 'O' THEN 'nuclear' ELSE 'natural_gas' END AS fuel_type, {_QEND.format('day')} AS date,
              CAST(SUM(CAST(l_quantity AS {_D})) AS DOUBLE) / 1e3 AS capacity_gw FROM li GROUP BY 1, 2""",
    "energy": f"""SELECT {case_sql('c_nationkey % 13', dict(enumerate(COUNTRIES)))} AS country, CAST(year(o_orderdate) AS INTEGER) AS year,
              ROUND(CAST(SUM(CAST(c_acctbal AS {_D})) AS DOUBLE) / COUNT(*) / 5e4, 6) AS renewables_pct,
              ROUND(CAST(SUM(CAST(o_totalprice AS {_D})) AS DOUBLE) / COUNT(*) / 6e2, 6) AS carbon_intensity_gco2_per_kwh
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "exposure": f"""SELECT ticker, {case_sql('c_mktsegment', REGION_OF_SEGMENT, "'other'")} AS region, CAST(COUNT(*) AS DOUBLE) AS weight
              FROM customer JOIN nat ON c_nationkey = n_nationkey WHERE ticker NOT LIKE '%5' GROUP BY 1, 2""",
    "currencies": "SELECT ticker, CASE WHEN layer = 'AFRICA' THEN 'USD' ELSE layer END AS currency, layer AS pair FROM nat",
    "rates": "SELECT layer AS pair, day AS date, 1.0::DOUBLE + COUNT(*)::DOUBLE / 10.0 AS rate FROM ord GROUP BY 1, 2",
    "options": f"""SELECT p_brand AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
              CAST(date_trunc('month', l_shipdate) AS DATE) + l_linenumber * 15 AS expiry,
              CASE WHEN l_returnflag = 'N' THEN 'call' ELSE 'put' END AS option_type, p_retailprice AS strike, l_discount AS iv,
              CAST(l_quantity AS BIGINT) AS oi, CAST(l_linenumber * 10 AS BIGINT) AS volume
              FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "positions": """SELECT ts AS timestamp, day, user_id AS mmsi, CAST(user_id % 120 AS INTEGER) AS vessel_type,
              CAST(event_id % 60 - 10 AS DOUBLE) AS latitude, CAST(user_id * 7 % 180 - 40 AS DOUBLE) AS longitude FROM ev""",
    "facts": """SELECT ticker, CASE o_orderstatus WHEN 'F' THEN 'Revenues' WHEN 'O' THEN 'SalesRevenueNet' ELSE 'GrossProfit' END AS concept,
              day AS "start", day + CAST(o_custkey % 120 AS INTEGER) AS "end", o_totalprice AS val,
              day + CAST(o_custkey % 7 + 120 AS INTEGER) AS filed, '10-Q' AS form FROM ord""",
    "filing": f"""SELECT doc_id AS filing_id, 'NATION_' || (doc_id % 25)::VARCHAR AS filer_ticker, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
              'doc/' || doc_id::VARCHAR AS url, text || ' Item 1.01 entry. The ' || {case_sql(f'doc_id % {len(AGREEMENT_WORDS)}', dict(enumerate(AGREEMENT_WORDS)))}
              || ' with Nation_' || (n_chars % 25)::VARCHAR || ' Corp covers ' || (n_chars % 997)::VARCHAR
              || CASE WHEN doc_id % 3 = 0 THEN ' gigawatt' ELSE ' MW' END || '! Terms follow.' AS text FROM documents""",
    "companies": "SELECT lower(ticker) AS company_name, ticker, n_nationkey AS ord FROM nat",
    "peers": """SELECT a.ticker, b.ticker AS peer FROM (SELECT s.*, UNNEST(range(least(20, n)::BIGINT)) AS i FROM (
              SELECT ticker, layer, g, SUM((layer <> g)::INTEGER) OVER (PARTITION BY g ORDER BY md5(ticker)) AS k, SUM((layer <> g)::INTEGER) OVER (PARTITION BY g) AS n
              FROM nat, (SELECT DISTINCT layer AS g FROM nat)) s WHERE layer = g AND n > 0) a
              JOIN (SELECT ticker, layer, g, SUM((layer <> g)::INTEGER) OVER (PARTITION BY g ORDER BY md5(ticker)) AS k FROM nat, (SELECT DISTINCT layer AS g FROM nat)) b
              ON b.layer <> b.g AND b.g = a.g AND b.k = (a.k + i) % a.n + 1""",
    "epx": f"""SELECT 'NATION_' || (user_id % 25)::VARCHAR AS ticker, day AS date,
              CAST(SUM(CAST(value AS {_D})) AS DOUBLE) / COUNT(*) AS close_price, COUNT(*) AS volume FROM ev GROUP BY 1, 2""",
    "pf": """SELECT ticker, date, close_price / NULLIF(LAG(close_price, 1) OVER w, 0) - 1 AS return_1d,
              close_price / NULLIF(LAG(close_price, 5) OVER w, 0) - 1 AS return_5d,
              close_price / NULLIF(LAG(close_price, 20) OVER w, 0) - 1 AS return_20d,
              close_price / NULLIF(AVG(close_price) OVER r, 0) - 1 AS sma_20_deviation,
              STDDEV_SAMP(close_price) OVER r / NULLIF(AVG(close_price) OVER r, 0) AS volatility_20d,
              volume / NULLIF(AVG(CAST(volume AS DOUBLE)) OVER r, 0) AS volume_ratio FROM px
              WINDOW w AS (PARTITION BY ticker ORDER BY date),
              r AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "preds": """SELECT ticker, date, ROUND(sma_20_deviation, 6) AS expected_annual_return, ROUND(return_1d, 6) AS lgbm_return,
              ROUND(return_5d, 6) AS rf_return, ROUND(return_20d, 6) AS ridge_return, UNNEST(['5d', '20d']) AS horizon
              FROM pf WHERE return_20d IS NOT NULL""",
    "panel": """SELECT pf.ticker, layer, pf.date, ROUND(return_20d, 6) AS predicted, ROUND(y, 6) AS actual FROM pf
              JOIN (SELECT ticker, date, LEAD(close_price, 20) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close_price, 0) - 1 AS y FROM px) f
              ON f.ticker = pf.ticker AND f.date = pf.date JOIN nat ON nat.ticker = pf.ticker
              WHERE return_20d IS NOT NULL AND y IS NOT NULL""",
}
