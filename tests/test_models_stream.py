import itertools
import random

import numpy as np
import pytest
from conftest import by_key, day
from pyspark.sql import functions as F

from tidespine.plans import evaluate as evl, models as ml, scoring
from tidespine.session import scratch_path
from tidespine.streaming import positions as sp

SMALL = ml.Settings(gbt_rounds=4, gbt_depth=2, min_leaf=1, trees=5, forest_depth=3)


@pytest.mark.parametrize("sign", [1, -1])
def test_ordered_predictions(spark, sign):
    preds = spark.createDataFrame([(f"T{i}", day(0), "5d", sign * (i + 1) / 100) for i in range(10)], "ticker string, date date, horizon string, expected_annual_return double")
    prices = spark.createDataFrame([(f"T{i}", day(j), 100.0 + (i if j == 5 else 0)) for i in range(10) for j in range(6)], "ticker string, date date, close_price double")
    r = evl.score_predictions(preds, prices, {"5d": 5}).collect()[0]
    assert r["ic"] == sign and r["top_decile_return"] == (0.09 if sign == 1 else 0.0) and r["n_tickers"] == 10 and r["first_exit"] == day(5)


def test_rank_correlation_with_ties(spark):
    df = spark.createDataFrame([(day(0), p, a) for p, a in ((1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0))] + [(day(1), 1.0, 1.0)] * 5, "date date, predicted double, actual double")
    out = by_key(evl.spearman_ic(df), "date")
    assert set(out) == {day(0)}
    assert out[day(0)]["ic"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2, 3.5, 3.5])[0, 1])


def test_agreement_and_freshness(spark):
    p = spark.createDataFrame([(0.1, 0.2, -0.1, 0.3), (0.0, 1.0, 1.0, 1.0)], "expected_annual_return double, lgbm_return double, rf_return double, ridge_return double")
    got = [r["model_agreement"] for r in evl.model_agreement(p).orderBy("expected_annual_return").collect()]
    assert got[0] is None and got[1] == pytest.approx(2 / 3)
    out = by_key(evl.freshness([("a", spark.createDataFrame([(day(0),)], "d date"), "d", "daily"), ("b", None, "d", "weekly")], str(day(4))), "source")
    assert out["a"]["status"] == "STALE" and out["a"]["age_days"] == 4 and out["b"]["status"] == "MISSING"


def test_displayed_percents(spark):
    df = spark.createDataFrame([("A", "5d", 0.5335, -0.5335, 0.1234)], "ticker string, horizon string, expected_annual_return double, confidence_low double, confidence_high double")
    assert tuple(evl.display(df).first()) == ("A", "5d", 53.4, -53.4, 12.3, 65.7)


def test_folds():
    assert evl.fold_bounds(1000, 100) == [(1, 700, 800), (2, 800, 900), (3, 900, 1000)]
    with pytest.raises(ValueError):
        evl.fold_bounds(349, 100)


def test_blend_weights_are_optimal(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        x = rng.normal(size=(60, 3))
        y = x @ rng.normal(size=3) + rng.normal(size=60) * 0.1
        df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
        w = np.array(list(ml.blend_weights(df, ["a", "b", "c"], "y").values()))
        if w.sum() and (w != [0.5, 0.5, 0.0]).any():
            assert (w >= 0).all() and w.sum() == pytest.approx(1)
            scale = max(0.0, (x @ w) @ y / ((x @ w) @ (x @ w)))
            grad = x.T @ (x @ (w * scale) - y)
            assert (grad[w > 1e-9] == pytest.approx(0, abs=1e-6)) and (grad[w <= 1e-9] >= -1e-6).all()


def test_active_sets_equal_the_enumeration():
    rng = np.random.default_rng(1)
    for k in [*range(1, 9)] * 4:
        x, y = rng.normal(size=(50, k)), rng.normal(size=50)
        if k > 2:
            x[:, 1] = x[:, 0]  # alike columns
        gram, rhs = x.T @ x, x.T @ y
        best = 0.0
        for on in itertools.product([False, True], repeat=k):
            on = np.array(on)
            w = np.linalg.lstsq(gram[np.ix_(on, on)], rhs[on], rcond=None)[0]
            if on.any() and (w >= 0).all():
                best = min(best, w @ gram[np.ix_(on, on)] @ w - 2 * rhs[on] @ w)
        w = ml.nonnegative(gram, rhs)
        assert (w >= 0).all() and w @ gram @ w - 2 * rhs @ w == pytest.approx(best, abs=1e-8)
    x, y = rng.normal(size=(400, 30)), rng.normal(size=400)
    gram, rhs = x.T @ x, x.T @ y
    w = ml.nonnegative(gram, rhs)
    slope = gram @ w - rhs
    assert (w >= 0).all() and abs(slope[w > 0]).max() < 1e-7 and slope.min() > -1e-7


def panel(spark, n=160):
    rng = random.Random(42)
    out = []
    for i in range(n):
        for t in "ABCD":
            x = rng.gauss(0, 1)
            out.append((t, "l1" if t < "C" else "l2", day(i), x, None if rng.random() < 0.1 else rng.gauss(0, 1), 0.5 * x + rng.gauss(0, 0.05)))
    return spark.createDataFrame(out, "ticker string, layer string, date date, f0 double, f1 double, label_return double")


def test_ensemble_learns_and_ridge_is_exact(spark):
    df = panel(spark)
    model = ml.train_in_sample(df, ["f0", "f1"], "label_return", SMALL)
    pdf = df.toPandas()
    x = pdf[["f0", "f1"]].fillna(pdf[["f0", "f1"]].median()).to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = pdf["label_return"].to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.array(model.ridge.coefficients) == pytest.approx(w, abs=1e-4)
    scored = model.predict(df)
    assert scored.agg(evl.pearson("expected_annual_return", "label_return")).first()[0] > 0.9
    inside = scored.agg(F.avg(F.col("label_return").between(F.col("confidence_low"), F.col("confidence_high")).cast("double"))).first()[0]
    assert 0.75 < inside < 0.85
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = ml.Ensemble.load(spark, path).predict(df)
    assert again.agg(F.sum("expected_annual_return")).first()[0] == pytest.approx(scored.agg(F.sum("expected_annual_return")).first()[0])


def test_walk_forward_and_backtest(spark):
    df = panel(spark)
    _, oof = ml.train(df, ["f0", "f1"], "label_return", 30, SMALL)
    m = evl.fold_metrics(oof).orderBy("fold").collect()
    assert [r["n_samples"] for r in m] == [120, 120, 120] and all(r["ic"] > 0.8 for r in m)
    r = ml.backtest(df, ["f0", "f1"], "label_return", str(day(80)), str(day(81)), str(day(150)), SMALL).collect()[0]
    assert r["months"] == 3 and r["mean_ic"] > 0 and r["hit_rate"] == 1.0


def test_groups_resume(spark):
    df = panel(spark)
    pairs = spark.createDataFrame([("l1", "20d"), ("l2", "20d")], "layer string, horizon string")
    done = pairs.where("layer = 'l1'")
    report = ml.train_groups(lambda layer, _h: (df.where(F.col("layer") == layer), ["f0"]), pairs, done, scratch_path(spark, "m"), SMALL)
    assert report == [("l2", "20d", 320)]


def test_scorers(spark):
    docs = spark.createDataFrame([(1, "Strong growth, no loss"), (2, None)], "id int, text string")
    out = by_key(scoring.lexicon_scores(docs, "text"), "id")
    assert out[1]["positive"] == pytest.approx(0.5) and out[1]["net_sentiment"] == pytest.approx(0.25) and out[2]["label"] == "neutral"
    def load():
        return lambda texts: [(0.1, 0.7, 0.2) for _ in texts]
    assert {r["label"] for r in scoring.model_scores(docs, "text", load).collect()} == {"negative"}


def test_trained_scorer_on_held_out_rows(spark):
    rng = random.Random(2)
    common, own = [f"w{i}" for i in range(200)], {"positive": [f"p{i}" for i in range(60)], "negative": [f"n{i}" for i in range(60)], "neutral": []}
    def text(label):
        return " ".join(rng.choice(own[label]) if own[label] and rng.random() < 0.15 else rng.choice(common) for _ in range(rng.randrange(20, 60)))
    rows = [(i, text(y), y) for i in range(600) for y in [rng.choice(list(own))]]
    df = spark.createDataFrame(rows, "id int, text string, y string").repartition(4)
    model = scoring.train_text_model(df.where("id % 3 > 0"), "text", "y")
    out = scoring.linear_scores(df.where("id % 3 = 0"), ["id"], "text", model)
    hits = [r["y"] == r["label"] for r in out.collect()]
    assert sum(hits) > 0.9 * len(hits) and len(hits) == 200
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "unknown words"), (3, "unknown words")], "id int, text string").distinct()
    got = by_key(scoring.linear_scores(odd, ["id"], "text", model), "id")
    shares = by_key(df.where("id % 3 > 0").groupBy("y").count(), "y")
    n = sum(r["count"] for r in shares.values()) + 3
    assert all(got[i]["positive"] == pytest.approx((shares["positive"]["count"] + 1) / n) for i in (1, 2, 3))


def test_closed_input_takes_open_windows_from_state(spark):
    src, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    rows = [(f"2024-01-0{d} 10:00:00", str(m)) for d in (1, 2, 5) for m in range(d)]
    body = '{"MetaData":{"MMSI":"%s","latitude":23.0,"longitude":120.0},"Message":{"ShipStaticData":{"Type":75}}}'
    landed = spark.createDataFrame([(body % m, t) for t, m in rows], "value string, arrival string").withColumn("arrival", F.col("arrival").cast("timestamp"))
    landed.write.mode("append").parquet(src)
    start = lambda: sp.write_counts(sp.cargo_counts(sp.parse_positions(sp.read_messages(spark, src))), out, state)
    start().awaitTermination()
    before = spark.read.parquet(out).count()
    whole = {tuple(r) for r in sp.cargo_counts(sp.parse_positions(landed)).collect()}
    sp.drain_and_close(start, src, sp.closing_message(spark))
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert before < len(whole) == len(got) and set(got) == whole


def test_stream_is_exactly_once_over_restarts(spark):
    src, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    msg = '{"MetaData":{"MMSI":"%d","latitude":%s,"longitude":120.0},"Message":{"PositionReport":{"Sog":1.0}}}'
    def land(ids, lat="23.0"):
        spark.createDataFrame([(msg % (i, lat),) for i in ids], "value string").withColumn("arrival", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(src)
    def run():
        sp.append_by_date(sp.parse_positions(sp.read_messages(spark, src)), out, state).awaitTermination()
    land([1, 2])
    land([9], "null")
    run()
    run()
    land([3], "60.5")
    run()
    got = spark.read.parquet(out)
    assert sorted((r["mmsi"], r["corridor"]) for r in got.collect()) == [("1", "taiwan_strait"), ("2", "taiwan_strait"), ("3", "other")]


def test_words_are_counted_inside_their_row(spark):
    from collections import Counter

    from tidespine.plans import scoring

    texts = ["b a b  c a b", "", None, "one", "x x x x", "É é e " * 50, " ".join(f"w{i % 7}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: {w["word"]: w["_n"] for w in r["c"]} for r in df.select("id", scoring.word_counts(scoring.words_in(F.col("text"))).alias("c")).collect()}
    assert got == {i: dict(Counter((t or "").lower().split())) for i, t in enumerate(texts)}
    model = spark.createDataFrame([("", -1.0, -1.0, -1.0), ("b", -1.0, -2.0, -3.0), ("w3", -3.0, -1.0, -2.0)], "word string, positive double, negative double, neutral double")
    scored = scoring.linear_scores(df, ["id"], "text", model)
    # one grouping, by row, after the join: none by row and word before it
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    by = {r["id"]: r for r in scored.collect()}
    assert [by[i]["label"] for i in (0, 1, 6)] == ["positive", "positive", "negative"] and abs(by[1]["positive"] - 1 / 3) < 1e-12


def test_registered_models_are_trained_whole(spark, monkeypatch):
    """Every registered model job asks for the sizes of the studied ensemble: 400 rounds, 300 trees."""
    from tidespine.catalog import q_models as q

    asked = []

    def fitted(df, features, label, settings=ml.Settings(), *args, **kwargs):
        asked.append(settings)
        raise InterruptedError

    monkeypatch.setattr(ml, "fit", fitted)
    monkeypatch.setattr(q, "sources", lambda t: None)
    days = [r["date"] for r in panel(spark, 1).select("date").collect()]
    df = panel(spark, 160).withColumn("date", F.date_add("date", -8900)).select("ticker", "date", "f0", "label_return")
    monkeypatch.setattr(q, "matrix", lambda t, h: (df, ["f0"]))
    monkeypatch.setattr(q.ds, "training_datasets", lambda src, hs: {h: df for h in hs})
    monkeypatch.setitem(q.ds.TIERS, "short", ["f0"])
    layers = spark.createDataFrame([(t, "ASIA" if t < "C" else "EUROPE") for t in "ABCD"], "ticker string, layer string")
    tables = type("Views", (), {"spark": spark, "layers": layers})()
    monkeypatch.setattr(ml.evl, "fold_bounds", lambda n, window, folds=3: [(1, n - 60, n)])
    monkeypatch.setattr(ml.evl, "walk_forward", lambda d, window, folds=3: d.withColumns({"position": F.datediff("date", F.lit(days[0])) + 8900, "fold": F.lit(1)}))
    monkeypatch.setattr(ml.evl, "date_split", lambda d, *spans: d.withColumn("split", F.when(F.col("ticker") < "C", "train").otherwise("test")))
    for job in (q.m03, q.m07, q.m08, q.m09, q.m10, q.m11):
        before = len(asked)
        with pytest.raises(InterruptedError):
            job(tables)
        assert len(asked) > before, job.__name__
    assert all(s == ml.Settings() and s.gbt_rounds == 400 and s.trees == 300 and s.forest_depth == 6 for s in asked)


def test_small_fits_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ml, "PART_ROWS", 100)
    df = panel(spark).coalesce(1)
    model = ml.fit(df, ["f0", "f1"], "label_return", SMALL, band=False)
    assert model.band is None and len(model.gbt.trees) == 1 and len(model.gbt.trees[0]) == SMALL.gbt_rounds
    got = ml.importances(model, spark).collect()
    assert [r["feature"] for r in got] == ["f0", "f1"] and sum(r["importance"] for r in got) == pytest.approx(1)
