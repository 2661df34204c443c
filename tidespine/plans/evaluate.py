"""Scoring predictions against outcomes: cross-sectional metrics, folds, portfolio metrics, freshness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.functions.scalar import change
from tidespine.operators.asof import asof_join
from tidespine.operators.calendar import calendar_index
from tidespine.operators.dedup import symmetrise
from tidespine.operators.intervals import interval_rows
from tidespine.operators.ranking import average_rank, exact_median, exact_quantiles, row_number_in_group
from tidespine.plans.price import HORIZONS
from tidespine.session import cut_lineage

MODELS = ["lgbm_return", "rf_return", "ridge_return"]
LIQUID_BILLIONS = 1.0
CADENCE_DAYS = {"daily": 3, "weekly": 10, "monthly": 60, "quarterly": 999}


def pearson(x: str, y: str) -> Column:
    """Correlation over rows with both values; null (not an error) when a side is constant."""
    a = F.when(F.col(y).isNotNull(), F.col(x))
    b = F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def hit_rate(x: str, y: str) -> Column:
    return F.avg((F.signum(x) == F.signum(y)).cast("double"))


def model_agreement(preds: DataFrame, score: str = "expected_annual_return", models: Sequence[str] = MODELS) -> DataFrame:
    """Share of sub-models that point the same way as the ensemble; null when it is exactly zero."""
    same = sum(((F.signum(m) == F.signum(score)).cast("double") for m in models), F.lit(0.0))
    return preds.withColumn("model_agreement", F.when(F.col(score) != 0, same / len(models)))


def liquidity(preds: DataFrame, caps: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Market value in billions and a flag for at least one billion; unknown is not liquid."""
    out = preds.join(caps.select(*keys, "market_cap_b"), list(keys), "left")
    return out.withColumn("is_liquid", F.coalesce(F.col("market_cap_b") >= LIQUID_BILLIONS, F.lit(False)))


def peer_correlation(preds: DataFrame, prices: DataFrame, top_n: int = 10, days: int = 90, min_returns: int = 5,
                     min_overlap: int = 10, positional: bool = False, keys: Sequence[str] = ("date",),
                     score: str = "expected_annual_return") -> DataFrame:
    """Mean pairwise return correlation among the ``top_n`` entities of each prediction set, by ``rank`` or else by ``score``.

    Returns align by date, or with ``positional`` by position from the newest row. Pairs form only
    inside the fixed top_n, so a set contributes at most top_n * (top_n - 1) of them. ``keys`` hold ``date``.
    """
    keys = list(keys)
    if "rank" not in preds.columns:  # a row_number with a bound: each task keeps its own best before the shuffle
        best = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), "ticker")
        top = preds.select(*keys, "ticker", F.row_number().over(best).alias("_rank")).where(F.col("_rank") <= top_n)
    else:
        top = preds.where(F.col("rank") <= top_n)
    top = top.select(*keys, "ticker").distinct()
    priced, half = (_by_position if positional else _by_day)(top, prices, keys, days, min_returns)
    pairs = symmetrise(half, "ticker", "_peer")  # each pair is correlated once and read both ways
    mean = pairs.where((F.col("_m") >= min_overlap) & F.col("_c").isNotNull()).groupBy(*keys, "ticker").agg(
        F.avg("_c").alias("_mean"))
    counts = priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    out = priced.join(counts, keys).join(mean, [*keys, "ticker"], "left").select(
        *keys, "ticker", F.when(F.col("_k") == 1, F.lit(0.0)).otherwise(F.round("_mean", 4)).alias("peer_correlation_90d"))
    return preds.join(out, [*keys, "ticker"], "left")


def _by_position(top: DataFrame, prices: DataFrame, keys: list[str], days: int, min_returns: int) -> tuple[DataFrame, DataFrame]:
    """(entities with returns enough, half of the pairs with overlap and correlation): returns meet at their place from the newest row of each set."""
    rows = interval_rows(top, prices.select("ticker", F.col("date").alias("_pd"), "close_price"), ["ticker"], "date", -days, 0, right_on="_pd")
    w = Window.partitionBy(*keys, "ticker").orderBy("fact_day")
    every = Window.partitionBy(*keys, "ticker")
    ret = rows.withColumn("_r", change("close_price", F.lag("close_price").over(w))).where("_r is not null")
    ret = ret.withColumn("_n", F.count("_r").over(every)).where(F.col("_n") > min_returns)
    ret = ret.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "ticker").orderBy(F.col("fact_day").desc())))
    a = ret.select(*keys, "ticker", "_pos", "_r")
    b = ret.select(*keys, F.col("ticker").alias("_peer"), "_pos", F.col("_r").alias("_s"))
    half = a.join(b, [*keys, "_pos"]).where(F.col("ticker") < F.col("_peer")).groupBy(*keys, "ticker", "_peer").agg(
        F.count(F.lit(1)).alias("_m"), pearson("_r", "_s").alias("_c"))
    return ret.select(*keys, "ticker").distinct(), half


def _by_day(top: DataFrame, prices: DataFrame, keys: list[str], days: int, min_returns: int) -> tuple[DataFrame, DataFrame]:
    """The same for returns that meet on their day. A pair has one correlation a day whatever the sets, so each pair's days are summed up once along its history, and a
    set's frame is the difference of two looked-up sums; sets join last. Returns are centred, so the differences keep their digits."""
    w = Window.partitionBy("ticker").orderBy("date")
    ret = prices.select("ticker", "date", change("close_price", F.lag("close_price").over(w)).alias("_r"), F.lag("date").over(w).alias("_since")).where("_r is not null")
    ret = cut_lineage(ret.withColumn("_r", F.col("_r") - F.avg("_r").over(Window.partitionBy("ticker"))))
    own = _frame_sums(top.select("ticker", "date").distinct(), ret, ["ticker"], days, {"n": F.lit(1)})
    priced = cut_lineage(top.join(own.where(F.col("n") > min_returns).select("ticker", "date"), ["ticker", "date"], "left_semi"))
    pairs = priced.join(priced.withColumnRenamed("ticker", "_peer"), keys).where(F.col("ticker") < F.col("_peer"))
    other = ret.select(F.col("ticker").alias("_peer"), "date", F.col("_r").alias("_s"), F.col("_since").alias("_also"))
    both = pairs.select("ticker", "_peer").distinct().join(ret, "ticker").join(other, ["_peer", "date"])
    both = both.withColumn("_since", F.least("_since", "_also"))
    x, y = F.col("_r"), F.col("_s")
    sums = _frame_sums(pairs.select("ticker", "_peer", "date").distinct(), both, ["ticker", "_peer"], days, {"n": F.lit(1), "x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y})
    n, vx, vy = F.col("n"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    # a constant side leaves only rounding noise, far below its own sum of squares
    varies = (vx > n * F.col("xx") * 1e-12) & (vy > n * F.col("yy") * 1e-12)
    corr = F.when(varies, (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy))
    return priced, pairs.join(sums.where("n > 0").select("ticker", "_peer", "date", n.alias("_m"), corr.alias("_c")), ["ticker", "_peer", "date"])


def _frame_sums(asked: DataFrame, rows: DataFrame, by: list[str], days: int, parts: dict[str, Column]) -> DataFrame:
    """For each (``by``, date) asked for, sums over the rows on or before it whose ``_since`` is at most ``days`` before it. ``_since`` never falls along a key's dates."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*by, F.col("date").alias("_at"), "_since", *[F.sum(e).over(w).alias(k) for k, e in parts.items()])
    upto = asof_join(asked, run.drop("_since"), on="date", right_on="_at", by=by, left_unique=True)
    gone = run.select(*by, F.greatest("_at", F.date_add("_since", days + 1)).alias("_gone"), F.col("_at").alias("_last"), *[F.col(k).alias(f"_{k}") for k in parts])
    past = asof_join(asked, gone, on="date", right_on="_gone", by=by, tie_break=["_last"], left_unique=True)
    return upto.join(past, [*by, "date"]).select(*by, "date", *[(F.coalesce(k, F.lit(0)) - F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in parts])


def rank_predictions(preds: DataFrame, by: Sequence[str], score: str = "expected_annual_return") -> DataFrame:
    """rank 1..n by score inside each prediction set, ties by ticker; no set has to fit one task."""
    ranked = row_number_in_group(preds, by, [F.col(score).desc_nulls_last(), F.col("ticker")], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("group_size")


def enrich(preds: DataFrame, caps: DataFrame, prices: DataFrame, positional: bool = False, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Agreement, liquidity and peer correlation for each prediction set named by ``keys``."""
    return peer_correlation(model_agreement(liquidity(preds, caps)), prices, positional=positional, keys=keys)


def realised(preds: DataFrame, prices: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """Prediction rows with the return from the close on the date to the close n rows later."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = F.array(*[F.struct(F.lit(tag).alias("horizon"), F.lead("close_price", n).over(w).alias("close"),
                               F.lead("date", n).over(w).alias("date")) for tag, n in horizons.items()])
    exits = prices.select("ticker", "date", F.col("close_price").alias("_in"), ahead.alias("_a")).select(
        "ticker", "date", "_in", F.explode("_a").alias("_x")).select(
        "ticker", "date", "_in", F.col("_x.horizon").alias("horizon"), F.col("_x.close").alias("_out"),
        F.col("_x.date").alias("exit_date")).where("_in > 0 and _out is not null")
    return preds.join(exits, ["ticker", "date", "horizon"]).withColumn("realized", F.col("_out") / F.col("_in") - 1).drop("_in", "_out")


def score_predictions(preds: DataFrame, prices: DataFrame, horizons: dict[str, int] = HORIZONS,
                      min_entities: int = 10, score: str = "expected_annual_return") -> DataFrame:
    """Per (date, horizon): entities, correlation, sign hits, top-decile return, exit-date range."""
    rows = realised(preds.where(F.col(score).isNotNull()), prices, horizons)
    keys = ["date", "horizon"]
    ranked = row_number_in_group(rows, keys, [F.col(score).desc(), F.col("ticker")], "_rn", "_n")
    top = F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tickers"), F.round(pearson(score, "realized"), 4).alias("ic"),
        F.round(hit_rate(score, "realized"), 4).alias("hit_rate"),
        F.round(F.avg(F.when(top, F.col("realized"))), 4).alias("top_decile_return"),
        F.min("exit_date").alias("first_exit"), F.max("exit_date").alias("last_exit")).where(F.col("n_tickers") >= min_entities)


def rebalance_dates(panel: DataFrame, on: str = "date") -> DataFrame:
    """First available day of each month."""
    return panel.groupBy(F.year(on).alias("year"), F.month(on).alias("month")).agg(F.min(on).alias("rebalance_date"))


def on_rebalance(panel: DataFrame, on: str = "date") -> DataFrame:
    days = rebalance_dates(panel, on).select(F.col("rebalance_date").alias(on))
    return panel.join(F.broadcast(days), on, "left_semi")


def spearman_ic(panel: DataFrame, predicted: str = "predicted", actual: str = "actual", on: str = "date",
                min_rows: int = 4) -> DataFrame:
    """Rank correlation per day with average ranks for ties; days with too few rows or no spread drop out."""
    panel = cut_lineage(panel.select(on, predicted, actual))  # ranked twice and joined back twice
    ranked = average_rank(average_rank(panel, [on], predicted, "_rp"), [on], actual, "_ra")
    return ranked.groupBy(on).agg(F.count(F.lit(1)).alias("n"), pearson("_rp", "_ra").alias("ic")).where(
        (F.col("n") >= min_rows) & F.col("ic").isNotNull())


def half_spread(panel: DataFrame, predicted: str = "predicted", actual: str = "actual", on: str = "date",
                min_rows: int = 4) -> DataFrame:
    """Mean outcome of the upper half by prediction minus the lower half, and whether it is positive."""
    panel = cut_lineage(panel.select(on, predicted, actual))
    mid = exact_median(panel, [on], predicted, "_mid")
    rows = panel.join(F.broadcast(mid), on)  # one row per day
    up = F.col(predicted) >= F.col("_mid")
    out = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(up, F.col(actual))).alias("_top"),
                               F.avg(F.when(~up, F.col(actual))).alias("_low"))
    out = out.where((F.col("n") >= min_rows) & F.col("_top").isNotNull() & F.col("_low").isNotNull())
    return out.select(on, (F.col("_top") > F.col("_low")).cast("double").alias("hit"), (F.col("_top") - F.col("_low")).alias("spread"))


def ic_summary(ics: DataFrame, spreads: DataFrame) -> DataFrame:
    """One row: mean IC, its deviation and t statistic, hit rate, mean spread."""
    on = ics.columns[0]
    both = ics.join(spreads, on, "full").agg(
        F.count("ic").alias("months"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"),
        F.avg("hit").alias("hit_rate"), F.avg("spread").alias("mean_spread"))
    t = F.when(F.col("ic_std") > 0, F.col("mean_ic") / (F.col("ic_std") / F.sqrt("months"))).otherwise(0.0)
    return both.withColumn("ic_tstat", t)


def date_split(df: DataFrame, cutoff: str, start: str, end: str, on: str = "date") -> DataFrame:
    """Rows tagged train (up to the cutoff) or test (start..end); rows between or after drop out."""
    day = lambda s: F.lit(s).cast("date")
    part = F.when(F.col(on) <= day(cutoff), "train").when(F.col(on).between(day(start), day(end)), "test")
    return df.withColumn("split", part).where("split is not null")


def fold_bounds(n_dates: int, window: int, folds: int = 3) -> list[tuple[int, int, int]]:
    """(fold, first validation position, end position) for expanding folds; refuses short histories."""
    need = window * folds + 50
    if n_dates < need:
        raise ValueError(f"{n_dates} distinct dates, need at least {need}")
    return [(k, n_dates - (folds - k + 1) * window, n_dates - (folds - k) * window) for k in range(1, folds + 1)]


def walk_forward(df: DataFrame, window: int = 252, folds: int = 3, on: str = "date") -> DataFrame:
    """Rows with their position and validation fold; a row trains every fold that starts after it.

    Only the count of distinct days reaches the driver.
    """
    calendar = calendar_index(df, on, "_idx")
    n = calendar.count()
    bounds = fold_bounds(n, window, folds)
    fold = F.lit(None).cast("int")
    for k, lo, hi in bounds:
        fold = F.when(F.col("_idx").between(lo, hi - 1), F.lit(k)).otherwise(fold)
    return df.join(F.broadcast(calendar), on).withColumn("fold", fold).withColumnRenamed("_idx", "position")


def fold_metrics(scored: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Per fold: rows, correlation, sign hits, mean outcome at or above the 90th percentile of predictions."""
    cut = exact_quantiles(scored, ["fold"], predicted, {"_p90": 0.9})
    rows = scored.join(F.broadcast(cut), "fold")  # one row per fold
    top = F.col(predicted) >= F.col("_p90")
    return rows.groupBy("fold").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count(F.lit(1)).alias("n_samples"),
        F.round(pearson(predicted, actual), 4).alias("ic"), F.round(hit_rate(predicted, actual), 4).alias("hit_rate"),
        F.round(F.avg(F.when(top, F.col(actual))), 4).alias("top_decile_return"))


def group_metrics(scored: DataFrame, group: str = "layer", min_rows: int = 10, predicted: str = "predicted",
                  actual: str = "actual") -> DataFrame:
    return scored.groupBy("fold", group).agg(
        F.count(F.lit(1)).alias("n"), F.round(pearson(predicted, actual), 4).alias("ic"),
        F.round(hit_rate(predicted, actual), 4).alias("hit_rate")).where(F.col("n") >= min_rows)


def entity_accuracy(scored: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Per (fold, entity): mean prediction and outcome, their directions, and whether they agree."""
    days = scored.groupBy("fold").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    out = scored.groupBy("fold", "ticker", "layer").agg(
        F.avg(predicted).alias("predicted_return"), F.avg(actual).alias("actual_return"), F.count(F.lit(1)).alias("n_observations"))
    return out.withColumns({
        "predicted_direction": F.signum("predicted_return").cast("int"),
        "actual_direction": F.signum("actual_return").cast("int"),
        "correct": F.signum("predicted_return") == F.signum("actual_return"),
    }).join(F.broadcast(days), "fold")


def fold_summary(folds: DataFrame, groups: DataFrame, group: str = "layer") -> DataFrame:
    """Means over folds plus the best and worst group of the last fold."""
    means = folds.agg(F.round(F.avg("ic"), 4).alias("mean_ic"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"),
                      F.round(F.avg("top_decile_return"), 4).alias("mean_top_decile_return"), F.max("fold").alias("_last"))
    ends = groups.where(F.col("ic").isNotNull()).groupBy("fold").agg(
        F.max_by(group, F.struct("ic", group)).alias("best_layer"), F.min_by(group, F.struct("ic", group)).alias("worst_layer"))
    return means.join(F.broadcast(ends), means["_last"] == ends["fold"], "left").drop("_last", "fold")


def freshness(sources: Sequence[tuple[str, DataFrame | None, str, str]], today: str) -> DataFrame:
    """(source, latest, age_days, status) for (name, table, date column, cadence); yearly ints mean January 1st."""
    parts = []
    for name, df, column, cadence in sources:
        limit = CADENCE_DAYS[cadence]
        if df is None:
            continue
        latest = F.max(column)
        if df.schema[column].dataType.typeName() in ("integer", "long"):
            latest = F.make_date(F.max(column).cast("int"), F.lit(1), F.lit(1))
        parts.append(df.agg(latest.cast("date").alias("latest")).select(
            F.lit(name).alias("source"), "latest", F.lit(limit).alias("_limit")))
    spark = next(df for _, df, _, _ in sources if df is not None).sparkSession
    absent = [(n, CADENCE_DAYS[c]) for n, df, _, c in sources if df is None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if absent:
        out = out.unionByName(spark.createDataFrame(absent, "source string, _limit int").withColumn("latest", F.lit(None).cast("date")))
    age = F.date_diff(F.lit(today).cast("date"), F.col("latest"))
    status = F.when(F.col("latest").isNull(), "MISSING").when(age > F.col("_limit"), "STALE").otherwise("OK")
    return out.select("source", "latest", age.alias("age_days"), status.alias("status"))


def display(preds: DataFrame) -> DataFrame:
    """Percent columns with one decimal and the band width, for every horizon there is. Ties are told at the tenth of a percent, so 0.5335 is 53.4 though 100 times it falls short of 53.35."""
    pct = lambda c: F.round(c * 100 * 10) / 10
    return preds.select("ticker", "horizon", pct(F.col("expected_annual_return")).alias("expected_pct"),
                        pct(F.col("confidence_low")).alias("low_pct"), pct(F.col("confidence_high")).alias("high_pct"),
                        pct(F.col("confidence_high") - F.col("confidence_low")).alias("width_pct"))
