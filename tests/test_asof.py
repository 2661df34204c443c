import datetime as dt
import random

import pytest
from conftest import by_key, day

from tidespine.operators.asof import asof_change, asof_join


def left(spark, days, ticker="A"):
    return spark.createDataFrame([(ticker, day(d)) for d in days], "ticker string, date date")


def right(spark, items, ticker="A"):
    return spark.createDataFrame([(ticker, day(d), v) for d, v in items], "ticker string, t date, v double")


def test_tolerance_is_inclusive(spark):
    out = by_key(asof_join(left(spark, [7, 8]), right(spark, [(0, 1.0)]), "date", "t", ["ticker"], tolerance_days=7), "date")
    assert out[day(7)]["v"] == 1.0 and out[day(8)]["v"] is None


def test_latest_row_may_be_null_and_future_is_ignored(spark):
    r = right(spark, [(0, 1.0), (3, None), (9, 5.0)])
    out = by_key(asof_join(left(spark, [2, 4, 8]), r, "date", "t", ["ticker"]), "date")
    assert [out[day(d)]["v"] for d in (2, 4, 8)] == [1.0, None, None]


def test_lag_and_tie_break(spark):
    out = by_key(asof_join(left(spark, [4, 5]), right(spark, [(0, 1.0)]), "date", "t", ["ticker"], lag_days=5), "date")
    assert out[day(4)]["v"] is None and out[day(5)]["v"] == 1.0
    r = spark.createDataFrame([("A", day(0), 1.0, 2), ("A", day(0), 9.0, 1)], "ticker string, t date, v double, seq int")
    assert asof_join(left(spark, [1]), r, "date", "t", ["ticker"], cols=["v"], tie_break=["seq"]).first()["v"] == 1.0


def test_duplicate_left_rows_survive(spark):
    l = spark.createDataFrame([("A", day(3), 1), ("A", day(3), 2), (None, day(3), 3)], "ticker string, date date, id int")
    out = by_key(asof_join(l, right(spark, [(1, 4.0)]), "date", "t", ["ticker"]), "id")
    assert out[1]["v"] == 4.0 and out[2]["v"] == 4.0 and out[3]["v"] is None


@pytest.mark.parametrize("bucket", [None, 3600, 60])
def test_random_timestamps_match_brute_force_with_a_hot_key(spark, bucket):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    pick = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    ls = [(i, pick(), start + dt.timedelta(seconds=rng.randrange(20000))) for i in range(300)]
    rs = {(pick(), start + dt.timedelta(seconds=rng.randrange(20000))): float(i) for i in range(200)}
    l = spark.createDataFrame(ls, "id int, k string, ts timestamp_ntz")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in rs.items()], "k string, rt timestamp_ntz, v double")
    got = {x["id"]: x["v"] for x in asof_join(l, r, "ts", "rt", ["k"], bucket_seconds=bucket).collect()}
    for i, k, t in ls:
        past = [(rt, v) for (rk, rt), v in rs.items() if rk == k and rt <= t]
        assert got[i] == (max(past)[1] if past else None)


def test_yearly_change(spark):
    s = spark.createDataFrame([(day(0), 10.0), (day(365), 15.0)], "d date, v double")
    spine = spark.createDataFrame([(day(370),), (day(500),)], "date date")
    out = by_key(asof_change(spine, s, "date", "d", "v", level="lvl", change="chg", tolerance_days=60), "date")
    assert out[day(370)]["chg"] == pytest.approx(0.5)
    assert out[day(500)]["lvl"] is None and out[day(500)]["chg"] is None
