import math
import random
import statistics

import numpy as np
import pytest
from conftest import by_key, day

from tidespine.operators.calendar import calendar_index, calendar_lag, fill_gaps, with_calendar
from tidespine.operators.windows import rank_position, realised_volatility, rolling_correlation, span_return, streak


def test_streak(spark):
    vals = [1.0, 2.0, -1.0, 3.0, None, 1.0, 1.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(vals)], "k string, i int, v double")
    out = by_key(streak(df, "v", "k", "i", "s"), "i")
    assert [out[i]["s"] for i in range(7)] == [1, 2, 0, 1, 0, 1, 2]
    assert by_key(streak(df, "v", "k", "i", "s", max_len=1), "i")[6]["s"] == 1


def test_calendar_lag_counts_calendar_rows(spark):
    df = spark.createDataFrame([("A", day(0), 1.0), ("B", day(1), 5.0), ("A", day(2), 2.0), ("B", day(2), 6.0)], "ticker string, date date, p double")
    out = by_key(calendar_lag(with_calendar(df), "p", 1, "back"), "ticker", "date")
    assert out["A", day(2)]["back"] is None and out["B", day(2)]["back"] == 5.0


def test_fill_gaps(spark):
    df = spark.createDataFrame([("A", day(1), 1.0), ("B", day(0), 5.0), ("B", day(3), 6.0)], "ticker string, date date, p double")
    out = sorted((r["ticker"], r["date"], r["p"]) for r in fill_gaps(df, calendar_index(df), "p").collect())
    assert out == [("A", day(1), 1.0), ("A", day(3), 1.0), ("B", day(0), 5.0), ("B", day(1), 5.0), ("B", day(3), 6.0)]


@pytest.mark.parametrize("length,overlap", [(10, 4), (60, 30), (1, 1)])
def test_rolling_correlation_with_gaps_and_constants(spark, length, overlap):
    rng = random.Random(11)
    series = {t: {} for t in "ABC"}
    for i in range(150):
        for t in "ABC":
            if rng.random() < 0.8 and not (t == "B" and i < 25):
                series[t][i] = 0.0 if t == "C" and i > 60 else rng.gauss(0, 0.02) + (5.0 if i == 70 and t == "A" else 0)
    df = spark.createDataFrame([(t, i, v) for t, s in series.items() for i, v in s.items()], "ticker string, idx int, r double")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A")], "ticker string, peer string")
    out = by_key(rolling_correlation(df, pairs, "r", length, overlap), "ticker", "peer", "idx")
    assert len(out) == 2 * len(series["A"]) + len(series["B"])
    for (t, p, i), r in out.items():
        xy = [(series[t][j], series[p][j]) for j in range(i - length + 1, i + 1) if j in series[t] and j in series[p]]
        assert r["overlap"] == len(xy)
        x, y = np.array(xy).T if xy else (np.array([]), np.array([]))
        if len(xy) >= overlap and len(xy) > 1 and x.std() > 1e-12 and y.std() > 1e-12:
            assert r["corr"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
        else:
            assert r["corr"] is None


def test_realised_volatility(spark):
    rng = random.Random(2)
    closes = [100 * math.exp(rng.gauss(0, 0.02)) for _ in range(50)]
    closes[30] = 0.0
    df = spark.createDataFrame([("A", day(i), c) for i, c in enumerate(closes)], "k string, d date, p double")
    out = by_key(realised_volatility(df, "p", "k", "d", "hv"), "d")
    assert out[day(1)]["hv"] is None
    def hv(i):
        lr = [math.log(b / a) if a > 0 and b > 0 else None for a, b in zip(closes[max(0, i - 34):i], closes[max(0, i - 34) + 1:i + 1])]
        return statistics.stdev([x for x in lr if x is not None][-30:]) * math.sqrt(252)
    for i in (2, 29, 33, 45, 49):
        assert out[day(i)]["hv"] == pytest.approx(hv(i))


def test_span_return_and_rank(spark):
    df = spark.createDataFrame([("A", day(d), p) for d, p in ((0, 10.0), (20, 12.0), (31, 9.0))], "k string, d date, p double")
    out = by_key(span_return(df, "p", "k", "d", 30, "r"), "d")
    assert out[day(0)]["r"] is None and out[day(20)]["r"] == pytest.approx(0.2) and out[day(31)]["r"] == pytest.approx(-0.25)
    pos = by_key(rank_position(df, "p", "k", "d", 252, 2, "x"), "d")
    assert pos[day(0)]["x"] == 50.0 and pos[day(20)]["x"] == 100.0 and pos[day(31)]["x"] == 0.0
