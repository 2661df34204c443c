"""Keep-one-per-key operators. Aggregates, not windows: they combine map-side, so hot keys are safe."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the largest ``order`` per key; remaining ties go to the largest whole row."""
    return _keep(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _keep(df, keys, order, F.min)


def _keep(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(pick(F.struct(*ranks, *rest)).alias("_best"))
    return best.select(*[F.col(f"_best.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append ``batch``; on equal keys its row replaces the current one."""
    both = current.withColumn("_gen", F.lit(0)).unionByName(batch.withColumn("_gen", F.lit(1)))
    return keep_latest(both, keys, ["_gen"]).drop("_gen")


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def symmetrise(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each undirected edge once per direction."""
    swapped = edges.withColumns({a: F.col(b), b: F.col(a)})
    return edges.unionByName(swapped.select(*edges.columns))


def pivot_sum(df: DataFrame, by: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with a fixed column list, missing cells 0. Fixed names save the extra scan."""
    sums = [F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value))), F.lit(0.0)).alias(n) for n in names]
    return df.groupBy(*by).agg(*sums)
