"""Text to facts: classification, capacity, amounts, names and tags as column expressions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidespine.functions.scalar import col

# Deal types in priority order with their keywords.
DEAL_KEYWORDS = {
    "power_purchase_agreement": ["power purchase agreement", "offtake agreement", "energy purchase agreement",
                                 "renewable energy agreement"],
    "supply_agreement": ["supply agreement", "supply contract", "purchase agreement", "procurement agreement",
                         "materials agreement"],
    "manufacturing_agreement": ["manufacturing agreement", "foundry agreement", "fab agreement",
                                "capacity reservation", "wafer supply agreement"],
    "customer_contract": ["customer agreement", "service agreement", "cloud agreement", "subscription agreement",
                          "gpu cluster"],
    "construction_contract": ["construction agreement", "epc agreement", "engineering",
                              "procurement and construction"],
    "joint_venture": ["joint venture", "jv agreement", "partnership agreement"],
    "investment": ["investment agreement", "equity investment", "financing agreement"],
    "licensing_agreement": ["license agreement", "licensing agreement", "ip agreement"],
}
# Buyer types in priority order with their keywords.
BUYER_KEYWORDS = {
    "hyperscaler": ["microsoft", "amazon", "aws", "google", "alphabet", "meta", "apple"],
    "crypto_miner": ["iren", "applied digital", "apld", "marathon digital", "riot platforms", "core scientific",
                     "bit digital", "bitfarms"],
    "utility": ["duke energy", "dominion", "southern company", "exelon", "entergy", "nextera", "eversource",
                "ameren", "xcel energy", "sempra"],
}
# Legal-form endings, stripped in this order.
LEGAL_SUFFIXES = [" corporation", " corp", " inc", " incorporated", " llc", " ltd", " limited", " co", " company",
                  " holdings", " technologies", " systems", " solutions"]
# Patent class buckets. Prefixes ending in a letter also cover numbered main groups.
CPC_BUCKETS = {"B25J": ["B25J"], "B64": ["B64C", "B64U"], "B60W": ["B60W"], "G05D1": ["G05D1"],
               "G05B19": ["G05B19"], "G06V": ["G06V"]}
# Sea corridors as (lat min, lat max, lon min, lon max).
CORRIDORS: dict[str, tuple[float, float, float, float]] = {
    "taiwan_strait": (21.5, 25.5, 119.0, 122.5),
    "anchorage": (60.0, 61.5, -150.5, -147.0),
    "rotterdam": (51.8, 52.0, 4.0, 4.5),
    "long_beach": (33.5, 34.0, -118.5, -118.0),
}
OVER_A_MILLION = 1_500_000.0


# Units of contracted capacity.
GIGAWATT, MEGAWATT = "GW|gigawatt", "MW|megawatt"


def classify(text: str | Column, keywords: Mapping[str, Sequence[str]], default: str) -> Column:
    """First class, in mapping order, with a keyword inside the text (case-insensitive)."""
    def first(low: Column) -> Column:
        out = F.lit(default)
        for name, words in reversed(list(keywords.items())):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.lower(col(text))), first), F.lit(0))  # the text is lower-cased once, then searched for plain words


def deal_type(text: str | Column) -> Column:
    return classify(text, DEAL_KEYWORDS, "customer_contract")


def buyer_type(name: str | Column) -> Column:
    return classify(name, BUYER_KEYWORDS, "other")


def deal_mw(text: str | Column) -> Column:
    """Capacity in MW: the first GW figure x 1000, else the first MW figure, else null."""
    def figure(unit):
        raw = F.regexp_extract(col(text), rf"(?i)(\d[\d,]*(?:\.\d+)?)\s*-?\s*(?:{unit})", 1)
        return F.nullif(F.regexp_replace(raw, ",", ""), F.lit("")).try_cast("double")
    return F.coalesce(figure(GIGAWATT) * 1000.0, figure(MEGAWATT))


def strip_markup(html: str | Column) -> Column:
    """Tags and non-breaking spaces to spaces, runs of whitespace to one."""
    s = F.regexp_replace(col(html), "<[^>]+>", " ")
    s = F.regexp_replace(s, "&nbsp;|&#160;", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def mention_sentence(text: str | Column, name: str | Column, length: int = 300, fallback: int = 200) -> Column:
    """First sentence that mentions the name, cut to ``length``; else the start of the text."""
    text = col(text)
    hits = F.filter(F.split(text, "[.!?]"), lambda s: F.contains(F.lower(s), col(name)))
    return F.substring(F.coalesce(F.trim(F.try_element_at(hits, F.lit(1))), F.trim(F.substring(text, 1, fallback))), 1, length)


def amount_band(text: str | Column) -> Column:
    """Midpoint of the first two figures, a single figure as is, 'over ...' as a fixed amount."""
    s = F.regexp_replace(F.lower(F.trim(col(text))), ",", "")
    nums = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("double"))
    return (F.when(F.contains(s, F.lit("over")), F.lit(OVER_A_MILLION))
            .when(F.size(nums) >= 2, (F.try_element_at(nums, F.lit(1)) + F.try_element_at(nums, F.lit(2))) / 2)
            .when(F.size(nums) == 1, F.try_element_at(nums, F.lit(1))))


def normalize_name(name: str | Column) -> Column:
    """Lower case, trimmed, legal-form endings removed one after the other."""
    s = F.trim(F.lower(col(name)))
    for suffix in LEGAL_SUFFIXES:
        s = F.trim(F.regexp_replace(s, suffix + r"\z", ""))
    return s


def cpc_bucket(code: str | Column) -> Column:
    """Bucket of a patent class: exact main group, or a subclass followed by a number."""
    head = F.split(col(code), "/")[0]
    out = F.lit(None).cast("string")
    for bucket, prefixes in reversed(list(CPC_BUCKETS.items())):
        pattern = "|".join(f"{p}(?:\\d.*)?" if p[-1].isalpha() else p for p in prefixes)
        out = F.when(head.rlike(f"^(?:{pattern})$"), F.lit(bucket)).otherwise(out)
    return out


def corridor(lat: str | Column, lon: str | Column, boxes: Mapping[str, tuple[float, float, float, float]] = CORRIDORS) -> Column:
    """First box that holds the point, else 'other'."""
    out = F.lit("other")
    for name, (a, b, c, d) in reversed(list(boxes.items())):
        out = F.when(col(lat).between(a, b) & col(lon).between(c, d), F.lit(name)).otherwise(out)
    return out


def security_id(static_id: str | Column, isin: str | Column) -> Column:
    """Nine-character id: the listed one, else characters 3-11 of a 12-character US code."""
    code = col(isin)
    return F.coalesce(col(static_id), F.when((F.length(code) == 12) & F.startswith(code, F.lit("US")), F.substring(code, 3, 9)))
