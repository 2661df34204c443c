import pytest
from conftest import by_key, day

from tidespine.plans.price import label_1y, labels_all, price_features

OHLCV = "ticker string, date date, close_price double, volume long"


def panel(spark, closes, ticker="A", volume=100):
    return spark.createDataFrame([(ticker, day(i), c, volume) for i, c in enumerate(closes)], OHLCV)


def test_returns(spark):
    r = by_key(price_features(panel(spark, [100.0, 110.0, 99.0])), "date")
    assert r[day(0)]["return_1d"] is None
    assert r[day(1)]["return_1d"] == pytest.approx(0.10)
    assert r[day(2)]["return_1d"] == pytest.approx(-0.10)
    assert r[day(2)]["volume_ratio"] == pytest.approx(1.0)
    assert r[day(0)]["volatility_20d"] is None


def test_zero_previous_close_gives_null(spark):
    assert by_key(price_features(panel(spark, [0.0, 10.0])), "date")[day(1)]["return_1d"] is None


def test_trailing_frame_holds_21_rows(spark):
    r = by_key(price_features(panel(spark, [1000.0] + [1.0] * 21)), "date")
    assert r[day(21)]["sma_20_deviation"] == pytest.approx(0.0)  # the first close has left the frame
    assert r[day(20)]["sma_20_deviation"] < -0.9


def test_one_date_equals_full_history(spark):
    p = panel(spark, [float(100 + i * i % 17) for i in range(60)])
    full = by_key(price_features(p), "date")[day(50)]
    one = price_features(p, str(day(50))).collect()
    assert len(one) == 1 and tuple(one[0]) == tuple(full)


def test_labels(spark):
    p = panel(spark, [float(i + 1) for i in range(260)])
    one = by_key(label_1y(p), "date")
    assert len(one) == 8 and one[day(0)]["label_return_1y"] == pytest.approx(252.0)
    many = by_key(labels_all(p, {"5d": 5, "252d": 252}), "date")
    assert len(many) == 260 and many[day(259)]["label_return_5d"] is None
    assert many[day(10)]["label_return_5d"] == pytest.approx(16 / 11 - 1)
