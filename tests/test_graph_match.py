import datetime as dt
import difflib
import random
import re

import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from tidespine.functions.text import normalize_name
from tidespine.operators.graph import decayed_edges, hops_to_set, proximity
from tidespine.operators import match
from tidespine.operators.match import contains_pairs, first_security, fuzzy_pairs, match_names, tag_entities
from tidespine.plans.market import partner_deals, partner_momentum, power_deals

EDGES = "ticker_from string, ticker_to string, edge_weight double"


def both_ways(spark, edges):
    return spark.createDataFrame([e for a, b, w in edges for e in ((a, b, w), (b, a, w))], EDGES)


def test_hops(spark):
    e = both_ways(spark, [("H", "a", 1.0), ("a", "b", 1.0), ("x", "y", 1.0)])
    nodes = spark.createDataFrame([(n,) for n in "Habxz"], "ticker string")
    out = by_key(hops_to_set(nodes, e, ["H"]).withColumn("p", proximity("hops")), "ticker")
    assert [out[n]["p"] for n in "Haxz"] == [1.0, 0.5, 0.0, 0.0] and out["b"]["p"] == pytest.approx(1 / 3)


def test_decayed_edge_weight(spark):
    d = spark.createDataFrame([(day(0), "B", "A", "t2", 1.0), (day(0), "A", "B", "t1", 0.0)], "date date, party_a string, party_b string, deal_type string, confidence double")
    out = by_key(decayed_edges(d, str(day(730))), "ticker_from", "ticker_to")
    assert len(out) == 2
    assert out["A", "B"]["edge_weight"] == pytest.approx(0.25, abs=0.01) and out["B", "A"]["edge_types"] == "t1|t2" and out["A", "B"]["deal_count"] == 2


def test_partner_momentum(spark):
    px = [("P", day(0), 100.0), ("P", day(20), 120.0), ("Q", day(5), 100.0), ("Q", day(25), 90.0), ("R", day(25), 1.0), ("T", day(25), 5.0)]
    prices = spark.createDataFrame(px, "ticker string, date date, close_price double")
    spine = spark.createDataFrame([("T", day(25)), ("T", day(60))], "ticker string, date date")
    out = by_key(partner_momentum(spine, prices, both_ways(spark, [("T", "P", 1.0), ("T", "Q", 0.5), ("T", "R", 9.0)])), "date")
    assert out[day(25)]["graph_partner_momentum_30d"] == pytest.approx((0.2 - 0.05) / 1.5)
    assert day(60) not in out


def test_partner_deals_match_brute_force(spark):
    rng = random.Random(4)
    names = "ABCDEF"
    edges = [(a, b, 1.0) for a in names for b in names if a < b and rng.random() < 0.6] + [("A", "A", 1.0)]
    deals = [(day(rng.randrange(120)), rng.choice(names), rng.choice(names), rng.choice(["power_purchase_agreement", "x"]), rng.choice([None, 5.0]), rng.choice(["hyperscaler", "other"]))
             for _ in range(200)]
    d = spark.createDataFrame(deals, "date date, party_a string, party_b string, deal_type string, deal_mw double, buyer_type string")
    spine = spark.createDataFrame([(n, day(i)) for n in names for i in (10, 60, 100)], "ticker string, date date")
    near = {n: {x for a, b, _ in edges for x, y in ((a, b), (b, a)) if y == n} for n in names}
    got, own = by_key(partner_deals(spine, d, both_ways(spark, edges)), "ticker", "date"), by_key(power_deals(spine, d), "ticker", "date")
    for (n, at), r in got.items():
        window = [x for x in deals if 0 <= (at - x[0]).days <= 90]
        assert r["graph_deal_count_90d"] == sum((x[1] in near[n] or x[2] in near[n]) and n not in (x[1], x[2]) for x in window)
        ppa = [x for x in window if n in (x[1], x[2]) and x[3] == "power_purchase_agreement"]
        assert own[n, at]["energy_deal_mw_90d"] == sum(x[4] or 0.0 for x in ppa)
        assert own[n, at]["hyperscaler_ppa_count_90d"] == sum(x[5] == "hyperscaler" for x in ppa)


@pytest.mark.parametrize("cutoff", [0.85, 0.93])
def test_fuzzy_pairs_find_every_match(spark, cutoff):
    rng = random.Random(8)
    base = ["advanced micro devices", "intel", "oracle", "ibm", "hewlett packard enterprise", "aaaaaa", "abab abab", "x", "ab"]
    def typo(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s[i:i + rng.randrange(2)] = rng.choice(["", "z", "ab", "a"])
        return "".join(s) or "q"
    names, aliases = {typo(rng.choice(base)) for _ in range(150)}, set(base) | {typo(b) for b in base}
    got = {(r["name"], r["alias"]) for r in fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string"),
                                                       spark.createDataFrame([(a,) for a in aliases], "alias string"), cutoff).collect()}
    want = {(n, a) for n in names for a in aliases if difflib.SequenceMatcher(None, n, a).ratio() >= cutoff}
    assert got == want


def test_low_cutoff_is_refused(spark):
    one = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(ValueError):
        fuzzy_pairs(one, one.withColumnRenamed("name", "alias"), 0.5)


def test_match_names(spark):
    raw = spark.createDataFrame([("NVIDIA Corp",), ("Nvidia Corporation",), ("Oracel Inc",), ("Unrelated",)], "raw string")
    t = spark.createDataFrame([("NVDA", "NVIDIA"), ("ORCL", "Oracle")], "ticker string, search_name string")
    assert {tuple(r) for r in match_names(raw, t, all_names=True).collect()} >= {("NVIDIA Corp", "NVDA"), ("Nvidia Corporation", "NVDA")}
    assert len(match_names(raw, t).where("ticker = 'NVDA'").collect()) == 1


def test_rows_of_names_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(n,) for n in ("NVIDIA Corp", "Micron Technology Inc", "Other LLC") * 20], "raw string").mapInArrow(seen, "raw string")
    t = spark.createDataFrame([("NVDA", "nvidia"), ("MU", "micron technology inc")], "ticker string, search_name string")
    got = {tuple(r) for r in match_names(rows, t, all_names=True).collect()}
    assert got == {("NVIDIA Corp", "NVDA"), ("Micron Technology Inc", "MU")} and read.value == 60


def test_normalize_name(spark):
    names = {"Acme Holdings Inc": "acme", " Foo Technologies LLC ": "foo technologies llc".replace(" llc", "").replace(" technologies", ""), "Co": "co", "Big Co Corp": "big"}
    out = {r["n"]: r["m"] for r in spark.createDataFrame([(n,) for n in names], "n string").withColumn("m", normalize_name("n")).collect()}
    assert out == names


@pytest.mark.parametrize("size", [0, 3, 6000])
def test_contains_pairs_for_any_dictionary(spark, size):
    rng = random.Random(size)
    texts = [(i, "".join(rng.choice("abcde \n") for _ in range(rng.randrange(80)))) for i in range(60)] + [(99, None)]
    pats = set()
    while len(pats) < size:
        pats.add("".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))))
    t = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame([(x,) for x in sorted(pats)] + [("",), (None,)], "p string")
    got = [tuple(r) for r in contains_pairs(t, p, "text", "p", ["id"]).collect()]
    want = {(i, x) for i, s in texts for x in pats if s and x in s}
    assert len(got) == len(want) and set(got) == want


def test_first_security(spark):
    h = spark.createDataFrame([(2, "C2", "Acme, Inc."), (1, "C1", "ACME Labs"), (3, "C3", "Other")], "ord int, cusip string, issuer string")
    t = spark.createDataFrame([("A", "acme"), ("Z", "zzz")], "ticker string, pattern string")
    assert [tuple(r) for r in first_security(h, t).collect()] == [("A", "C1")]


def test_alias_tagger_matches_regex_search(spark):
    aliases = {"AMZN": ["Amazon", "AWS", "Amazon Web Services"], "MU": ["Micron", "Micron Technology"], "TECH": ["Technology"], "KLAC": ["KLA"], "AT": ["AT&T"]}
    texts = ["amazon web services and Micron Technology", "Micronized", "the kla-tencor deal", "AT&T; aws", "éKLA KLAé", "", "Amazonian Amazon"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, n) for k, names in aliases.items() for n in names], "entity string, alias string")
    assert {tuple(r["tags"]) for r in tag_entities(df, F.col("text"), rows.limit(0)).collect()} == {()}
    out = by_key(tag_entities(df, F.col("text"), rows), "i")
    for i, s in enumerate(texts):
        want = sorted(k for k, names in aliases.items() if re.search("|".join(rf"\b{re.escape(n)}\b" for n in names), s, re.IGNORECASE))
        assert out[i]["tags"] == want


# Fixed values worked out by hand: two partners, a third one two hops from a hub.
LINKS = [("NVDA", "TSM", 1.0), ("NVDA", "ENTG", 0.5)]


def test_partner_momentum_is_the_weighted_mean(spark):
    prices = spark.createDataFrame([("TSM", dt.date(2023, 12, 15), 100.0), ("TSM", dt.date(2024, 1, 14), 120.0),
                                    ("ENTG", dt.date(2023, 12, 15), 50.0), ("ENTG", dt.date(2024, 1, 14), 45.0), ("NVDA", dt.date(2024, 1, 14), 500.0)],
                                   "ticker string, date date, close_price double")
    spine = spark.createDataFrame([("NVDA", dt.date(2024, 1, 14)), ("LONE", dt.date(2024, 1, 14))], "ticker string, date date")
    out = by_key(partner_momentum(spine, prices, both_ways(spark, LINKS)), "ticker")
    assert out["NVDA"]["graph_partner_momentum_30d"] == pytest.approx((1.0 * 0.20 + 0.5 * -0.10) / 1.5) and "LONE" not in out
    bare = spark.createDataFrame([], EDGES)
    assert partner_momentum(spine, prices, bare).count() == 0


def test_proximity_to_a_hub(spark):
    edges = both_ways(spark, [("MSFT", "NVDA", 1.0), ("NVDA", "TSM", 0.9), ("FCX", "SCCO", 0.5)])
    nodes = spark.createDataFrame([(t,) for t in ("MSFT", "NVDA", "TSM", "FCX")], "ticker string")
    out = by_key(hops_to_set(nodes, edges, ["MSFT"]).withColumn("p", proximity("hops")), "ticker")
    assert [out[t]["p"] for t in ("MSFT", "NVDA", "TSM", "FCX")] == [1.0, 0.5, pytest.approx(1 / 3), 0.0]


def test_partner_deals_read_the_deals_once(spark):
    deals = spark.range(90).selectExpr("concat('T', id % 3) AS party_a", "concat('T', id % 4) AS party_b", "DATE'2024-03-01' + CAST(id % 9 AS INT) AS date")
    spine = spark.createDataFrame([("T0", dt.date(2024, 4, 15))], "ticker string, date date")
    plan = partner_deals(spine, deals, both_ways(spark, [("T0", "T1", 1.0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 90") <= 1


def test_partner_deals_leave_out_own_deals(spark):
    deals = spark.createDataFrame([("NVDA", "TSM", dt.date(2024, 3, 15)), ("TSM", "ENTG", dt.date(2024, 3, 20))], "party_a string, party_b string, date date")
    spine = spark.createDataFrame([("NVDA", dt.date(2024, 4, 15))], "ticker string, date date")
    assert partner_deals(spine, deals, both_ways(spark, LINKS)).first()["graph_deal_count_90d"] == 1.0


def test_wordless_patterns_and_anchor_rows(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "c++", "::", "a-b", "naïve", "x", "€5", ""]) for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    words = ["alpha", "c++", "::", "a-b", "€5", "x beta", "  ", "ï", "", None, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.id, r.w) for r in match.contains_pairs(df, p, "text", "w", ["id"]).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w and w in t}
    got = {(r.id, r.w) for r in match.word_pairs(df, p, "text", "w", ["id"]).collect()}
    bounded = lambda w, t: re.search(rf"\b{re.escape(w)}\b", t) is not None
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w and bounded(w, t)}


def test_few_positions_become_rows(spark):
    # common beginnings, rare ends: anchors at the beginning would make a row of most texts' positions
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("etaoin") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rnd.choice(plain) for _ in range(60)) for _ in range(400)]
    patterns = [f"{plain[i]} {plain[i + 1]} {plain[i + 2]}" for i in range(0, 60, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame([(w,) for w in patterns], "w string")
    anchors, parts = match._gram_anchors(df, p, "text", "w")
    held, bits = match._anchor_bits(anchors)
    n = df.select(F.explode(parts).alias("_g")).join(anchors, "_g", "left_semi").count()
    assert anchors.count() == len(patterns) and n < sum(map(len, texts)) / 10
    got = {(r.id, r.w) for r in match.contains_pairs(df, p, "text", "w", ["id"]).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in patterns if w in t}


@pytest.mark.parametrize("piece", [5, 1 << 18])
def test_texts_are_scanned_as_bytes(spark, monkeypatch, piece):
    # patterns at both ends of a text, over the border of two texts and of two pieces, in letters of one to four bytes
    monkeypatch.setattr(match, "PIECE", piece)
    rnd = random.Random(6)
    texts = [None, "", *("".join(rnd.choice("abé語🎈 ") for _ in range(rnd.randrange(40))) for _ in range(200))]
    words = {t[i : i + n] for t in texts[2:] for n in (1, 2, 3, 5, 9, 20) for i in (0, 3, len(t) - n) if 0 <= i < len(t)} | {"".join(texts[3:6])[3:25]} - {""}
    df, p = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "id int, other string, text string"), spark.createDataFrame([(w,) for w in words], "w string")
    found = match.contains_pairs(df, p, "text", "w", ["id", "other"])
    got = [(r.id, r.other, r.w) for r in found.collect()]
    want = {(i, str(i), w) for i, t in enumerate(texts) for w in words if t and w in t}
    assert len(got) == len(want) and set(got) == want
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()  # no string for each position


def test_names_that_share_most_bigrams_hardly_meet(spark, monkeypatch):
    # numbered names: nearly all share the word and zeros, few are alike
    names = [f"supplier#{i:09d}" for i in range(1, 61)]
    aliases = [f"supplier{i * 7919:09d}" for i in range(1, 501)]
    n, a = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in aliases], "alias string")
    want = {(n, a) for n in names for a in aliases if difflib.SequenceMatcher(None, n, a).ratio() >= 0.9}
    monkeypatch.setattr(match, "similarity", lambda a, b: F.lit(1.0))  # all pairs that are scored
    scored = {(r["name"], r["alias"]) for r in fuzzy_pairs(n, a, 0.9).collect()}
    assert want <= scored and len(scored) < 300  # of 30,000


@pytest.mark.parametrize("sent", [0, 1, 50_000])
def test_hops_send_small_frontiers_and_shuffle_large_ones(spark, monkeypatch, sent):
    from tidespine.operators import graph

    monkeypatch.setattr(graph, "SENT", sent)
    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 40}", 1.0) for i in range(40)] + [("x", "y", 1.0)]
    near, level, want = {}, {"n0"}, {"n0": 0}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while level := {b for a in level for b in near[a]} - want.keys():
        want |= dict.fromkeys(level, max(want.values()) + 1)
    edges = both_ways(spark, pairs + pairs)  # repeated edges change nothing
    nodes = edges.select(F.col("ticker_from").alias("ticker"))
    for said in (False, True):
        got = {r["ticker"]: r["hops"] for r in hops_to_set(nodes, edges, ["n0"], both_ways=said).collect()}
        assert got == {n: want.get(n) for n in near}
