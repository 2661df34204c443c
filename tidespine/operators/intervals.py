"""Aggregates over a date interval relative to each spine row, as window frames instead of joins.

Facts are first summed to one partial per (key, day) with a map-side combine, so a hot key shrinks to
the number of calendar days before the window sees it. All intervals share one window pass.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Span:
    """Aggregate ``how`` of ``value`` over days [d+lo, d+hi], both ends inclusive.

    ``how`` is sum, count, avg, stddev, min, max, or last_day (latest fact day). Sum and count of
    nothing are null and 0; the others are null.
    """

    name: str
    how: str
    value: Column | None
    lo: int
    hi: int = 0


_PARTS = {"sum": ("s", "n"), "count": ("n",), "avg": ("s", "n"), "stddev": ("s", "n", "q"),
          "min": ("lo",), "max": ("hi",)}


def span_agg(spine: DataFrame, facts: DataFrame, by: Sequence[str], on: str, spans: Sequence[Span],
             facts_on: str | None = None) -> DataFrame:
    """One row per distinct (by, on) of the spine with one column per span.

    With ``by`` empty both sides shrink to one row per day first, so the single window group is
    bounded by the calendar. Counts and exact sums (integers, decimals) are differences of two running
    sums, which cost one step per row whatever the span; floating sums keep a sliding frame, because
    a difference of running sums would lose digits.
    """
    by = list(by)
    facts_on = facts_on or on
    values: dict[str, int] = {}
    parts: dict[str, Column] = {}
    plan = []
    for s in spans:
        v = s.value if s.value is not None else F.lit(1)
        tag = values.setdefault(str(v), len(values))
        for p in _PARTS[s.how]:
            name = f"_{p}{tag}"
            parts.setdefault(name, {
                "s": F.sum(v), "n": F.count(v), "q": F.sum(v.cast("double") * v.cast("double")),
                "lo": F.min(v), "hi": F.max(v)}[p].alias(name))
        plan.append((s, tag))
    daily = facts.where(F.col(facts_on).isNotNull()).groupBy(*by, F.col(facts_on).alias("__day")).agg(*parts.values())
    exact = {f.name for f in daily.schema.fields if f.dataType.typeName() in ("long", "decimal")}
    days = spine.select(*by, F.col(on).alias("__day")).distinct().withColumn("__want", F.lit(True))
    rows = daily.unionByName(days, allowMissingColumns=True)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.unix_date("__day"))

    def running(name: str, upto: int) -> Column:
        return F.coalesce(F.sum(name).over(w.rangeBetween(Window.unboundedPreceding, upto)), F.lit(0))

    def total(name: str, s: Span) -> Column:
        if name in exact:
            return running(name, s.hi) - running(name, s.lo - 1)
        return F.sum(name).over(w.rangeBetween(s.lo, s.hi))

    outs = []
    for s, tag in plan:
        f = w.rangeBetween(s.lo, s.hi)
        n = total(f"_n{tag}", s)
        if s.how == "sum":
            e = F.when(n > 0, total(f"_s{tag}", s))
        elif s.how == "count":
            e = n.cast("long")
        elif s.how == "avg":
            e = F.try_divide(total(f"_s{tag}", s).cast("double"), n.cast("double"))
        elif s.how == "stddev":
            sq, sm = F.sum(f"_q{tag}").over(f), total(f"_s{tag}", s).cast("double")
            ss = sq - F.try_divide(sm * sm, n.cast("double"))
            e = F.when(n > 1, F.sqrt(F.greatest(ss, F.lit(0.0)) / (n - 1)))
        elif s.how == "min":
            e = F.min(f"_lo{tag}").over(f)
        else:
            e = F.max(f"_hi{tag}").over(f)
        outs.append(e.alias(s.name))
    return rows.select(*by, "__day", "__want", *outs).where("__want").withColumnRenamed("__day", on).drop("__want")


def distinct_in_span(spine: DataFrame, facts: DataFrame, by: Sequence[str], on: str, member: str,
                     back_days: int, out: str, facts_on: str | None = None) -> DataFrame:
    """Exact count of distinct members with a fact in [d-back_days, d], without collecting any set.

    A member seen on day t counts from t until it is seen again or falls out of the window, so each
    sighting adds +1 at t and -1 at min(next sighting, t+back_days+1). Summing the changes per day and
    running them forward gives the distinct count. Members are never gathered per key.
    """
    by = list(by)
    facts_on = facts_on or on
    seen = facts.where(F.col(facts_on).isNotNull() & F.col(member).isNotNull()).select(
        *by, member, F.col(facts_on).alias("__day")).distinct()
    again = F.lead("__day").over(Window.partitionBy(*by, member).orderBy("__day"))
    seen = seen.withColumn("_end", F.least(F.date_add("__day", back_days + 1), again))
    steps = seen.select(*by, F.explode(F.array(
        F.struct(F.col("__day"), F.lit(1).cast("long").alias("_c")),
        F.struct(F.col("_end").alias("__day"), F.lit(-1).cast("long").alias("_c")))).alias("_e"))
    steps = steps.groupBy(*by, F.col("_e.__day").alias("__day")).agg(F.sum("_e._c").alias("_c"))
    days = spine.select(*by, F.col(on).alias("__day")).distinct().withColumn("__want", F.lit(True))
    rows = steps.unionByName(days, allowMissingColumns=True)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.unix_date("__day")).rangeBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn(out, F.coalesce(F.sum("_c").over(w), F.lit(0).cast("long")))
            .where("__want").select(*by, F.col("__day").alias(on), out))


def interval_rows(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, lo: int, hi: int = 0,
                  right_on: str | None = None) -> DataFrame:
    """Left rows joined to every right row of the key dated in [d+lo, d+hi].

    The range becomes an equi-join: days are cut into buckets as wide as the window, and each left row
    looks up the one to two buckets its window touches, so cost follows the matches, not key history.
    """
    by = list(by)
    right_on = right_on or on
    width = hi - lo + 1
    bucket = lambda days: F.floor(days / F.lit(width))
    first, last = F.unix_date(on) + lo, F.unix_date(on) + hi
    probes = left.withColumn("__b", F.explode(F.sequence(bucket(first), bucket(last))))
    facts = right.withColumn("__day", F.col(right_on)).withColumn("__b", bucket(F.unix_date("__day")))
    facts = facts.drop(right_on) if right_on in left.columns and right_on not in by else facts
    joined = probes.join(facts, [*by, "__b"])
    inside = F.date_diff("__day", on).between(lo, hi)
    return joined.where(inside).drop("__b").withColumnRenamed("__day", "fact_day")
