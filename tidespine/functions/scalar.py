"""Column expressions shared by the feature plans. All stay inside whole-stage codegen."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(x: str | Column, y: str | Column) -> Column:
    """x / y as double, null when y is zero or null."""
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


def change(now: str | Column, before: str | Column) -> Column:
    """now / before - 1, null when ``before`` is zero or null."""
    return ratio(now, before) - F.lit(1.0)


def yoy(now: str | Column, before: str | Column) -> Column:
    """(now - before) / before, null when ``before`` is zero or null."""
    return ratio(col(now) - col(before), before)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound x; unlike bare ``greatest``/``least`` a null stays null."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def zero_fill(x: str | Column) -> Column:
    return F.coalesce(col(x), F.lit(0.0))


def null_if_zero(x: str | Column) -> Column:
    return F.nullif(col(x), F.lit(0))


def any_not_null(*cols: str) -> Column:
    """True when at least one of the columns holds a value."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])


def first_present(existing: Sequence[str], *aliases: str) -> Column:
    """First non-null value among the aliases that exist; NaN counts as missing."""
    found = [F.nanvl(F.col(f"`{a}`").cast("double"), F.lit(None).cast("double"))
             for a in aliases if a in existing]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def lookup(key: str | Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """A literal dictionary lookup for small fixed mappings; larger ones belong in a joined table."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(default))


def undirected_key(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The two ends of an undirected pair in canonical order."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def rounded(df, digits: int = 6):
    """Round every double column, for comparing results across engines."""
    return df.select([
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
