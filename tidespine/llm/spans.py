"""Places of a pattern's matches as column expressions. DataFrame functions only."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, kind: str, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` along an array of ``kind``, null for null. The array is cut into as many parts as a part is long, so the
    steps grow as the 1.5th power of its length, where appending one after another would grow as the square."""
    def prefix(part: Column) -> Column:
        add = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), x)).otherwise(x)))
        return F.aggregate(part, F.array().cast(f"array<{kind}>"), add)

    def whole(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / wide).cast("int") - 1), lambda i: prefix(F.slice(v, i * wide + 1, wide)))
        return once(parts, lambda p: once(prefix(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(
            p, lambda x, i: F.when(i > 0, F.transform(x, lambda y: op(F.get(ends, i - 1), y))).otherwise(x)))))

    return once(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def running_sum(values: Column) -> Column:
    return running(values, "int", lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, "int", lambda a, b: F.greatest(a, b))


def cut(text: Column, places: Column) -> Column:
    """The pieces of a text from each of the ascending ``places`` (int) to the next one. Finding a place costs a walk from the text's beginning, so the text
    is first cut into as many lengths as each then holds pieces."""
    def between(t: Column, base: Column, p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.substring(t, F.get(p, i - 1) - base + 1, F.get(p, i) - F.get(p, i - 1)))

    def whole(p: Column) -> Column:
        n = F.size(p) - 1
        wide = F.ceil(F.sqrt(n)).cast("int")

        def stretch(i: Column) -> Column:
            own = F.slice(p, i * wide + 1, wide + 1)
            return once(own, lambda q: once(F.substring(text, F.get(q, 0) + 1, F.element_at(q, -1) - F.get(q, 0)), lambda t: between(t, F.get(q, 0), q)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / wide).cast("int") - 1), stretch))

    return once(places, lambda p: F.when(F.size(p) > 1, whole(p)).otherwise(F.array().cast("array<string>")))


def merged(spans: Column) -> Column:
    """Disjoint (start, end) of spans that overlap, for spans in order of start; those that only touch stay apart."""
    def groups(s: Column) -> Column:
        return once(running_max(F.transform(s, lambda x: x["end"])), lambda top: once(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(top, i - 1))), lambda first: F.transform(
                first, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(top, F.coalesce(F.get(first, k + 1), F.size(s)) - 1).alias("end")))))

    return once(spans, lambda s: F.when(F.size(s) > 0, groups(s)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each of the disjoint, ascending ``spans`` given as ``by`` of its length."""
    def whole(s: Column) -> Column:
        places = F.concat(F.array(F.lit(0)), F.flatten(F.transform(s, lambda x: F.array(x["start"], x["end"]))), F.array(F.length(text)))
        return F.array_join(F.transform(cut(text, places), lambda piece, i: F.when(i % 2 == 1, by(F.length(piece))).otherwise(piece)), "")

    return once(spans, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(text))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), code points with the end exclusive; ``value`` is the group's text.

    The text between matches and the matches themselves alternate, so places are running lengths of both. A text without a match, which one
    search tells, costs no more than that search.
    """
    def place(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        ends = running_sum(F.zip_with(gaps, whole, lambda g, w: F.length(g) + F.length(w)))
        zipped = F.arrays_zip(ends.alias("end"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        return F.transform(zipped, lambda z: F.struct((z["end"] - F.length(z["whole"])).alias("start"), z["end"].alias("end"), z["value"].alias("value")))

    return F.when(text.rlike(pattern), once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
