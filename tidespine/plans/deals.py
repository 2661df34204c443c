"""Agreement text and a manual list to one deal table and its decayed relationship edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidespine.functions.text import DEAL_KEYWORDS, buyer_type, deal_mw, deal_type, mention_sentence
from tidespine.operators.dedup import diagonal_union
from tidespine.operators.graph import decayed_edges
from tidespine.operators.match import contains_pairs

ITEM_MARKER = "item 1.01"
TEXT_CONFIDENCE = 0.7


def candidate_filings(filings: DataFrame, text: str = "text") -> DataFrame:
    """Filings that announce an agreement by marker or keyword; the rest never reach the name join."""
    words = [ITEM_MARKER] + [w for ws in DEAL_KEYWORDS.values() for w in ws]
    low = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return filings.where(hit)


def text_deals(filings: DataFrame, names: DataFrame, prefilter: bool = True) -> DataFrame:
    """(filing_id, filer_ticker, date, url, text) x (company_name, ticker, ord) to deal rows.

    One row per (filing, counterparty): the first company name in dictionary order that the text
    mentions; a filer never deals with itself. Classification runs once per filing.
    """
    docs = candidate_filings(filings) if prefilter else filings
    low = docs.select("filing_id", F.lower("text").alias("_low"))
    hits = contains_pairs(low, names.select("company_name"), "_low", "company_name", ["filing_id"])
    named = hits.join(names.select("company_name", F.col("ticker").alias("party_b"), "ord"), "company_name")
    first = named.groupBy("filing_id", "party_b").agg(F.min_by("company_name", "ord").alias("company_name"))
    sides = first.groupBy("filing_id").agg(F.collect_list(F.struct("party_b", "company_name")).alias("_sides"))
    rows = docs.join(sides, "filing_id").select(
        "filing_id", "date", F.col("filer_ticker").alias("party_a"), "text", "url", deal_type("text").alias("deal_type"),
        deal_mw("text").alias("deal_mw"), F.filter("_sides", lambda s: s["party_b"] != F.col("filer_ticker")).alias("_sides"))
    return rows.withColumn("_side", F.explode("_sides")).select(
        "filing_id", "date", "party_a", F.col("_side.party_b").alias("party_b"), "deal_type",
        mention_sentence("text", "_side.company_name").alias("description"), F.lit("8-K").alias("source"),
        F.col("url").alias("source_url"), F.lit(TEXT_CONFIDENCE).alias("confidence"), "deal_mw",
        buyer_type("_side.company_name").alias("buyer_type"))


def build_deals(manual: DataFrame, from_text: DataFrame, layers: DataFrame) -> DataFrame:
    """Manual (full confidence) and extracted deals as one table with group columns and a deal id."""
    manual = manual.withColumns({"source": F.lit("manual"), "confidence": F.lit(1.0)})
    both = diagonal_union(manual, from_text.drop("filing_id")).withColumn(
        "buyer_type", F.coalesce("buyer_type", F.lit("other")))
    side = lambda p: layers.select(F.col("ticker").alias(f"party_{p}"), F.col("layer").alias(f"layer_{p}"))
    out = both.join(side("a"), "party_a", "left").join(side("b"), "party_b", "left")
    return out.withColumns({
        "layer_a": F.coalesce("layer_a", "party_a"), "layer_b": F.coalesce("layer_b", "party_b"),
        "deal_id": F.concat_ws("-", "party_a", "party_b", F.col("date").cast("string"))})


def build_edges(deals: DataFrame, as_of) -> DataFrame:
    return decayed_edges(deals, as_of).withColumn("deal_count", F.col("deal_count").cast("int"))
