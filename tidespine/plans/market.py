"""Families fed by the whole price panel or the deal graph: peers, currency, options, partners."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidespine.functions.scalar import change, ratio, zero_fill
from tidespine.operators.asof import asof_join
from tidespine.operators.calendar import calendar_change, calendar_index, fill_gaps, with_calendar
from tidespine.operators.graph import hops_to_set, proximity
from tidespine.operators.intervals import Span, span_agg
from tidespine.operators.windows import realised_volatility, rolling_correlation
from tidespine.session import cut_lineage

KEYS = ["ticker", "date"]
SUPPLY_COLS = ["own_layer_momentum_20d", "ecosystem_momentum_20d", "supply_chain_correlation_60d",
               "peer_eps_surprise_mean"]
FX_COLS = ["fx_adjusted_return_20d"]
OPTION_COLS = ["iv_rank_30d", "iv_hv_spread", "put_call_oi_ratio", "put_call_vol_ratio", "skew_otm", "iv_term_slope"]
GRAPH_COLS = ["graph_partner_momentum_30d", "graph_deal_count_90d", "graph_hops_to_hyperscaler"]
DEAL_COLS = ["energy_deal_mw_90d", "hyperscaler_ppa_count_90d"]
# The hub set that graph distance is measured to.
HUBS = ["MSFT", "AMZN", "GOOGL", "META"]


def correlation_peers(layers: DataFrame, count: int = 20) -> DataFrame:
    """(ticker, peer): for each entity the next ``count`` entities of other groups, all if there are fewer.

    Entities stand on a ring ordered by the digest of their name, so the choice is fixed and mixes groups. An entity's place
    among the others of its group is a running count, and peers are found by that place: an equi-join, no pairs are formed and dropped.
    The ring is one row per entity of the registry; below it there is one row per entity and group.
    """
    placed = layers.select("ticker", "layer").withColumns({
        "_r": F.row_number().over(Window.orderBy(F.md5("ticker"))), "_groups": F.collect_set("layer").over(Window.partitionBy())})
    seen = placed.select("ticker", "layer", "_r", F.explode("_groups").alias("_g"))
    foreign = (F.col("layer") != F.col("_g")).cast("int")
    of_group = Window.partitionBy("_g")
    seen = seen.withColumns({"_k": F.sum(foreign).over(of_group.orderBy("_r")), "_n": F.sum(foreign).over(of_group)})
    step = F.explode(F.sequence(F.lit(0), F.least(F.lit(count), "_n") - 1)).alias("_s")
    seekers = seen.where("layer = _g and _n > 0").select("ticker", "_g", "_k", "_n", step)
    seekers = seekers.select("ticker", "_g", ((F.col("_k") + F.col("_s")) % F.col("_n") + 1).alias("_k"))
    offered = seen.where("layer <> _g").select("_g", "_k", F.col("ticker").alias("peer"))
    return seekers.join(offered, ["_g", "_k"]).select("ticker", "peer")


def layer_momentum(spine: DataFrame, returns: DataFrame, layers: DataFrame, value: str = "ret_20d",
                   min_own: int = 2, min_other: int = 5) -> DataFrame:
    """Mean return of the own group without oneself, and of all other groups.

    Totals per (group, day) and per day minus the part to leave out replace a loop over peers.
    """
    known = returns.where(F.col(value).isNotNull()).join(layers, "ticker").select("ticker", "layer", "date", value)
    group = known.groupBy("layer", "date").agg(F.sum(value).alias("_gs"), F.count(value).alias("_gn"))
    every = known.groupBy("date").agg(F.sum(value).alias("_as"), F.count(value).alias("_an"))
    df = (spine.select(*KEYS).join(layers, "ticker", "left").join(known.select(*KEYS, value), KEYS, "left")
          .join(group, ["layer", "date"], "left").join(F.broadcast(every), "date", "left"))
    own = F.col(value).isNotNull().cast("int")
    gn, gs = F.coalesce("_gn", F.lit(0)), F.coalesce("_gs", F.lit(0.0))
    n_own, n_other = gn - own, F.col("_an") - gn
    has_layer = F.col("layer").isNotNull()
    return df.select(
        *KEYS,
        F.when(has_layer & (n_own >= min_own), (gs - F.coalesce(value, F.lit(0.0))) / n_own).alias("own_layer_momentum_20d"),
        F.when(has_layer & (n_other >= min_other), (F.col("_as") - gs) / n_other).alias("ecosystem_momentum_20d"))


def daily_returns(panel: DataFrame, calendar: DataFrame, price: str = "close_price", gaps: bool = True) -> DataFrame:
    """(ticker, date, idx, ret) against the previous calendar row; gaps carry the last price forward."""
    rows = panel.where(F.col(price).isNotNull()).select(*KEYS, price)
    rows = fill_gaps(rows, calendar, price) if gaps else rows.join(calendar, "date")
    return calendar_change(rows, price, 1, "ret")


def peer_correlation(spine: DataFrame, panel: DataFrame, pairs: DataFrame, length: int = 60, min_overlap: int = 30,
                     min_peers: int = 5, price: str = "close_price", gaps: bool = True) -> DataFrame:
    """Mean rolling correlation with the fixed peers, at the latest calendar row on or before each day."""
    calendar = calendar_index(panel)
    returns = cut_lineage(daily_returns(panel, calendar, price, gaps).where(F.col("ret").isNotNull()).select("ticker", "idx", "ret"))
    corr = rolling_correlation(returns, pairs, "ret", length, min_overlap)
    mean = corr.where(F.col("corr").isNotNull()).groupBy("ticker", "idx").agg(
        F.when(F.count("corr") >= min_peers, F.avg("corr")).alias("supply_chain_correlation_60d"))
    days = asof_join(spine.select("date").distinct(), calendar.withColumnRenamed("date", "_c"), on="date",
                     right_on="_c", left_unique=True)
    return (spine.select(*KEYS).join(F.broadcast(days), "date", "left").join(mean, ["ticker", "idx"], "left")
            .select(*KEYS, "supply_chain_correlation_60d"))


def peer_surprise(spine: DataFrame, earnings: DataFrame, layers: DataFrame) -> DataFrame:
    """Mean surprise of the other group members reported in [d-90, d]: group window minus own window."""
    facts = earnings.where(F.col("eps_surprise_pct").isNotNull()).join(layers, "ticker").select(
        "ticker", "layer", F.col("quarter_end").alias("date"), "eps_surprise_pct")
    spans = [Span("_s", "sum", F.col("eps_surprise_pct"), -90), Span("_n", "count", F.col("eps_surprise_pct"), -90)]
    placed = spine.select(*KEYS).join(layers, "ticker", "left")
    group = span_agg(placed.where(F.col("layer").isNotNull()), facts, ["layer"], "date", spans)
    own = span_agg(spine, facts, ["ticker"], "date", spans).select(*KEYS, F.col("_s").alias("_os"), F.col("_n").alias("_on"))
    df = placed.join(group, ["layer", "date"], "left").join(own, KEYS, "left")
    n = F.col("_n") - F.col("_on")
    return df.select(*KEYS, F.when(n > 0, (F.col("_s") - F.coalesce("_os", F.lit(0.0))) / n).alias("peer_eps_surprise_mean"))


def supply_chain_features(spine: DataFrame, panel: DataFrame, layers: DataFrame, pairs: DataFrame,
                          earnings: DataFrame, base_prices: DataFrame | None = None) -> DataFrame:
    """All four peer features. ``base_prices`` (ticker, date, close_price) in one currency feeds correlation."""
    returns = calendar_change(with_calendar(panel.select(*KEYS, "close_price")), "close_price", 20, "ret_20d")
    spine = spine.select(*KEYS)
    momentum = layer_momentum(spine, returns, layers)
    corr = peer_correlation(spine, base_prices if base_prices is not None else panel, pairs)
    return momentum.join(corr, KEYS, "left").join(peer_surprise(spine, earnings, layers), KEYS, "left")


def base_currency_prices(panel: DataFrame, currencies: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """Close in the base currency; ``currencies`` is (ticker, currency, pair). A missing rate gives null."""
    df = panel.join(currencies, "ticker", "left").join(rates.select("pair", "date", "rate"), ["pair", "date"], "left")
    local = F.coalesce("currency", F.lit(base)) == base
    return df.select(*KEYS, F.when(local, F.col("close_price")).otherwise(F.col("close_price") * F.col("rate")).alias("close_price"))


def fx_features(spine: DataFrame, panel: DataFrame, currencies: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """20-calendar-row return in the base currency for foreign entities; the calendar is theirs alone."""
    foreign = panel.join(currencies.where(F.col("currency") != base).select("ticker"), "ticker", "left_semi")
    prices = base_currency_prices(foreign, currencies, rates, base)
    moved = calendar_change(with_calendar(prices), "close_price", 20, FX_COLS[0])
    return spine.select(*KEYS).join(moved.select(*KEYS, FX_COLS[0]), KEYS, "left")


def _nearest_expiry(target: int, longest: int) -> Column:
    ahead = F.date_diff("expiry", "date")
    key = F.struct(F.abs(ahead - target).alias("d"), F.col("expiry").alias("e"))
    return F.min(F.when((ahead > 0) & (ahead <= longest), key))


def nearest_expiry(contracts: DataFrame, target: int, longest: int) -> DataFrame:
    """Per (ticker, date): the expiry nearest ``target`` days ahead, at most ``longest``; ties go earlier."""
    return contracts.groupBy(*KEYS).agg(_nearest_expiry(target, longest)["e"].alias("expiry")).where("expiry is not null")


def _quotes(contracts: DataFrame) -> DataFrame:
    """One row per (ticker, date, expiry, type, strike): summed sizes, contracts, smallest positive iv."""
    return contracts.groupBy(*KEYS, "expiry", "option_type", "strike").agg(
        F.sum("oi").alias("oi"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("iv") > 0, F.col("iv"))).alias("iv"))


def option_features(contracts: DataFrame, prices: DataFrame) -> DataFrame:
    """Six option features per (ticker, date) that has contracts; zeros when no near expiry exists.

    Contracts are read once and reduced to (expiry, type, strike) cells first; the spot is the median near-term strike. A day of an entity has
    at most a few hundred cells, so expiries, spot, picks and their volatilities are windows and one aggregate over the same layout.
    """
    day = Window.partitionBy(*KEYS)
    cells = _quotes(contracts).withColumns({"_near": _nearest_expiry(30, 45).over(day)["e"], "_mid": _nearest_expiry(90, 180).over(day)["e"]})
    # an entity without a name is no entity; a day without either expiry keeps its cells, so that it has a row
    is_at = lambda c: F.coalesce(F.col("ticker").isNotNull() & (F.col("expiry") == F.col(c)), F.lit(False))
    cells = cells.withColumns({"_is_near": is_at("_near"), "_is_mid": is_at("_mid")})
    cells = cells.where(F.col("_is_near") | F.col("_is_mid") | F.col("ticker").isNull() | (F.col("_near").isNull() & F.col("_mid").isNull()))
    near, mid = F.col("_is_near"), F.col("_is_mid")
    put, call = near & (F.col("option_type") == "put"), near & (F.col("option_type") == "call")
    strike, spot = F.col("strike"), F.col("spot")
    cells = cells.withColumn("spot", F.percentile(F.when(near, strike.cast("double")), 0.5, F.col("n")).over(day))
    picked = lambda target, cond: F.min(F.when(cond, F.struct(F.abs(strike - target).alias("d"), strike.alias("k")))).over(day)["k"]
    cells = cells.withColumns({
        "_atm": picked(spot, near), "_mid_atm": picked(spot, mid),
        "_put": picked(spot * 0.925, put & strike.between(spot * 0.88, spot * 0.97)),
        "_call": picked(spot * 1.075, call & strike.between(spot * 1.03, spot * 1.12))})
    sums = lambda c, side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))
    least_iv = lambda cond: F.min(F.when(cond, F.col("iv")))

    def at_the_money(side: Column, at: str) -> Column:
        """The call's volatility if any call trades there, else any contract's; 0 if none."""
        here = side & (strike == F.col(at))
        calls = here & (F.col("option_type") == "call")
        return F.coalesce(F.when(F.max(calls), least_iv(calls)).otherwise(least_iv(here)), F.lit(0.0))

    df = cells.groupBy(*KEYS).agg(
        F.max(F.when(spot > 0, spot)).alias("spot"), F.max("_put").alias("_put"), F.max("_call").alias("_call"),
        F.coalesce(ratio(sums("oi", put), sums("oi", call)), F.lit(0.0)).alias("put_call_oi_ratio"),
        F.coalesce(ratio(sums("volume", put), sums("volume", call)), F.lit(0.0)).alias("put_call_vol_ratio"),
        F.coalesce(least_iv(put & (strike == F.col("_put"))), F.lit(0.0)).alias("_piv"),
        F.coalesce(least_iv(call & (strike == F.col("_call"))), F.lit(0.0)).alias("_civ"),
        at_the_money(near, "_atm").alias("_iv"), F.when(F.max(mid), at_the_money(mid, "_mid_atm")).alias("_iv_mid"))
    vol = realised_volatility(prices.select(*KEYS, "close_price"), "close_price", "ticker", "date", "_hv")
    df = asof_join(df, vol.select("ticker", F.col("date").alias("_pd"), "_hv"), on="date", right_on="_pd",
                   by=["ticker"], left_unique=True)
    rows = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_pos", F.when(F.col("spot").isNotNull() & (F.col("_iv") > 0), F.col("_iv"))).withColumn("_seen", F.count("_pos").over(rows))
    year = Window.partitionBy("ticker").orderBy("_seen").rangeBetween(-251, 0)
    lo, hi = F.min("_pos").over(year), F.max("_pos").over(year)
    placed = F.greatest(F.lit(0.0), F.least(F.lit(100.0), ratio(F.col("_iv") - lo, hi - lo) * 100.0))
    rank = F.when((F.col("_seen") < 30) | (hi <= lo), F.lit(50.0)).otherwise(placed)
    live = F.col("spot").isNotNull()
    wing = F.when(F.col("_put").isNotNull() & F.col("_call").isNotNull(), F.col("_piv") - F.col("_civ"))
    values = {
        "iv_rank_30d": rank, "iv_hv_spread": F.col("_iv") - F.col("_hv"),
        "put_call_oi_ratio": F.col("put_call_oi_ratio"), "put_call_vol_ratio": F.col("put_call_vol_ratio"),
        "skew_otm": wing, "iv_term_slope": F.col("_iv") - F.col("_iv_mid"),
    }
    return df.select(*KEYS, *[zero_fill(F.when(live, e)).alias(c) for c, e in values.items()])


def partner_momentum(spine: DataFrame, prices: DataFrame, edges: DataFrame, days: int = 30) -> DataFrame:
    """Edge-weighted mean of the partners' price change inside [d-days, d], for each own day d.

    A partner's change is computed once per day of the spine's calendar and then meets its edges; weighted sums per (entity, day)
    combine before the shuffle, and the spine joins last.
    """
    links = edges.select(F.col("ticker_from").alias("ticker"), F.col("ticker_to").alias("partner"), "edge_weight")
    calendar = spine.agg(F.collect_set("date")).scalar()  # one value per calendar day
    probe = links.select("partner").distinct().select("partner", F.explode(calendar).alias("date"), F.lit(True).alias("_want"))
    rows = prices.select(F.col("ticker").alias("partner"), "date", F.col("close_price").alias("_p"))
    w = Window.partitionBy("partner").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    moved = rows.unionByName(probe, allowMissingColumns=True).select(
        "partner", "date", "_want",
        F.when(F.count("_p").over(w) >= 2, change(F.last("_p", ignorenulls=True).over(w),
                                                  F.first("_p", ignorenulls=True).over(w))).alias("_r"))
    moved = moved.where("_want and _r is not null").drop("_want")
    mean = links.join(moved, "partner").groupBy(*KEYS).agg(
        ratio(F.sum(F.col("edge_weight") * F.col("_r")), F.sum("edge_weight")).alias("graph_partner_momentum_30d"))
    return mean.join(spine.select(*KEYS).distinct(), KEYS, "left_semi")


def partner_deals(spine: DataFrame, deals: DataFrame, edges: DataFrame, days: int = 90) -> DataFrame:
    """Deals of direct partners in [d-days, d] that do not involve the entity itself.

    Inclusion and exclusion on (party_a, party_b, day) counts: every partner's deals, minus deals between
    two partners (counted for both), minus the partners' deals with the entity. The three signed parts
    add up per day; no deal is listed once per entity and made distinct. The counts are read three times
    and written once, so the deals themselves are read once.
    """
    cells = cut_lineage(deals.groupBy("party_a", "party_b", "date").agg(F.count(F.lit(1)).alias("_n")))
    links = edges.select(F.col("ticker_from").alias("ticker"), F.col("ticker_to").alias("_party")).distinct()
    links = links.where(F.col("ticker") != F.col("_party"))
    by_party = cells.select(F.explode(F.array_distinct(F.array("party_a", "party_b"))).alias("_party"), "date", "_n")
    by_party = by_party.groupBy("_party", "date").agg(F.sum("_n").alias("_n"))
    each = links.join(by_party, "_party").select("ticker", "date", "_n")
    pairs = cells.where(F.col("party_a") != F.col("party_b")).groupBy(
        F.least("party_a", "party_b").alias("_party"), F.greatest("party_a", "party_b").alias("_other"), "date").agg(F.sum("_n").alias("_n"))
    second = links.withColumnRenamed("_party", "_other")
    shared = pairs.join(links, "_party").join(second, ["ticker", "_other"], "left_semi").select("ticker", "date", (-F.col("_n")).alias("_n"))
    sides = F.explode(F.array(F.struct(F.col("_party").alias("ticker"), F.col("_other").alias("_party")),
                              F.struct(F.col("_other").alias("ticker"), F.col("_party").alias("_party")))).alias("_e")
    own = pairs.select(sides, "date", "_n").select("_e.*", "date", "_n").join(links, ["ticker", "_party"], "left_semi").select(
        "ticker", "date", (-F.col("_n")).alias("_n"))
    facts = each.unionByName(shared).unionByName(own)
    return span_agg(spine, facts, ["ticker"], "date", [Span("_d", "sum", F.col("_n"), -days)]).select(
        *KEYS, zero_fill(F.col("_d").cast("double")).alias("graph_deal_count_90d"))


def power_deals(spine: DataFrame, deals: DataFrame, days: int = 90) -> DataFrame:
    """Contracted power and hub-buyer contracts of the entity itself in [d-days, d]."""
    own = deals.where(F.col("deal_type") == "power_purchase_agreement").withColumn(
        "ticker", F.explode(F.array_distinct(F.array("party_a", "party_b"))))
    hub = F.when(F.col("buyer_type") == "hyperscaler", 1).otherwise(0)
    return span_agg(spine, own, ["ticker"], "date", [
        Span("_mw", "sum", F.coalesce("deal_mw", F.lit(0.0)), -days), Span("_n", "sum", hub, -days)]).select(
        *KEYS, zero_fill(F.col("_mw").cast("double")).alias(DEAL_COLS[0]), zero_fill(F.col("_n").cast("double")).alias(DEAL_COLS[1]))


def graph_features(spine: DataFrame, prices: DataFrame, edges: DataFrame, deals: DataFrame,
                   hubs: Sequence[str] = HUBS) -> DataFrame:
    """All five graph features per (ticker, date). Hop distances are computed once per entity."""
    spine = spine.select(*KEYS).distinct()
    edges = cut_lineage(edges)  # read by three features and by every hop
    nodes = spine.select("ticker").distinct()
    hops = hops_to_set(nodes.unionByName(edges.select(F.col("ticker_from").alias("ticker"))).distinct(), edges, hubs)
    hops = hops.select("ticker", proximity("hops").alias("graph_hops_to_hyperscaler"))
    return (spine.join(partner_momentum(spine, prices, edges), KEYS, "left")
            .join(partner_deals(spine, deals, edges), KEYS, "left")
            .join(power_deals(spine, deals), KEYS, "left")
            .join(hops, "ticker", "left")
            .withColumn("graph_hops_to_hyperscaler", zero_fill("graph_hops_to_hyperscaler")))


def attach_graph(spine: DataFrame, features: DataFrame) -> DataFrame:
    return asof_join(spine, features, on="date", by=["ticker"], cols=GRAPH_COLS + DEAL_COLS)
