import random
import statistics

import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from tidespine.operators.intervals import Span, distinct_in_span, interval_rows, span_agg

FACTS = "k string, t date, who string, v double, n int"


def fixture(seed=3, size=400):
    """One key holds about half of the facts."""
    rng = random.Random(seed)
    pick = lambda: "hot" if rng.random() < 0.5 else rng.choice("ab")
    facts = [(pick(), day(rng.randrange(80)), rng.choice("pqrst"), rng.choice([None, rng.random()]), rng.randrange(5)) for _ in range(size)]
    spine = sorted({(pick(), day(rng.randrange(100))) for _ in range(60)})
    return facts, spine


def test_spans_match_brute_force(spark):
    facts, spine = fixture()
    f, s = spark.createDataFrame(facts, FACTS), spark.createDataFrame(spine, "k string, date date")
    v, n = F.col("v"), F.col("n")
    spans = [Span("total", "sum", v, -14, -8), Span("rows", "count", v, -14, -8), Span("mean", "avg", v, -30), Span("sd", "stddev", v, -30),
             Span("lo", "min", v, -7), Span("hi", "max", v, -7), Span("ints", "sum", n, -10), Span("late", "count", None, -3, -1)]
    out = by_key(span_agg(s, f, ["k"], "date", spans, facts_on="t"), "k", "date")
    assert len(out) == len(spine)
    for k, d in spine:
        def vals(lo, hi, i, keep_null=False):
            return [x[i] for x in facts if x[0] == k and lo <= (x[1] - d).days <= hi and (keep_null or x[i] is not None)]
        r, a, b, c = out[k, d], vals(-14, -8, 3), vals(-30, 0, 3), vals(-7, 0, 3)
        assert r["total"] == (pytest.approx(sum(a)) if a else None) and r["rows"] == len(a)
        assert r["mean"] == (pytest.approx(sum(b) / len(b)) if b else None)
        assert r["sd"] == (pytest.approx(statistics.stdev(b)) if len(b) > 1 else None)
        assert r["lo"] == (min(c) if c else None) and r["hi"] == (max(c) if c else None)
        ints = vals(-10, 0, 4)
        assert r["ints"] == (sum(ints) if ints else None)
        assert r["late"] == len(vals(-3, -1, 4, True))


def test_distinct_members_match_brute_force(spark):
    facts, spine = fixture(5)
    out = by_key(distinct_in_span(spark.createDataFrame(spine, "k string, date date"), spark.createDataFrame(facts, FACTS), ["k"], "date",
                                  "who", 20, "members", facts_on="t"), "k", "date")
    for k, d in spine:
        assert out[k, d]["members"] == len({x[2] for x in facts if x[0] == k and -20 <= (x[1] - d).days <= 0})


def test_interval_rows_match_brute_force(spark):
    facts, spine = fixture(9, 150)
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(facts)], "id int, " + FACTS)
    got = interval_rows(spark.createDataFrame(spine, "k string, date date"), f, ["k"], "date", -9, 2, right_on="t")
    want = {(k, d, i) for k, d in spine for i, x in enumerate(facts) if x[0] == k and -9 <= (x[1] - d).days <= 2}
    found = [(r["k"], r["date"], r["id"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_global_spans(spark):
    f = spark.createDataFrame([(day(0), 1.0), (day(0), 2.0), (day(5), 4.0)], "t date, v double")
    s = spark.createDataFrame([(day(5),), (day(9),)], "date date")
    out = by_key(span_agg(s, f, [], "date", [Span("x", "sum", F.col("v"), -5)], facts_on="t"), "date")
    assert out[day(5)]["x"] == 7.0 and out[day(9)]["x"] == 4.0
