"""Secret scans: base patterns, and Markov models of random against ordinary strings. DataFrame functions only.

Two first-order character models are counted from labelled samples. A long token is a secret if its log-likelihood ratio, random over ordinary, is
high enough; patterns find the secrets whose form is known.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidespine.llm.spans import matches, merged, once, replaced

#: Kind, pattern, group that holds the secret, least length of that group.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # of a run of these letters only one long enough counts, and the leftmost match starts where the run does
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
KINDS = [k for k, *_ in BASE] + ["markov"]
#: Words of letters and numbers of digits; a string of both is neither.
ORDINARY = r"(?<![A-Za-z0-9_])(?:[A-Za-z_]{4,}|[0-9]{4,})(?![A-Za-z0-9_])"
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    """``documents``: documents aimed at for the labelled sample, by hash; ``made``: strings of the random class made from digests of numbers."""

    documents: int = 3000
    made: int = 3000
    least_length: int = 16
    least_ratio: float = 12.0


def base_spans(text: Column) -> Column:
    """Base secrets as an array of (start, kind, end) in order of start, then kind as listed in ``KINDS``."""
    def spans_of(kind: int) -> Column:
        _, pattern, group, least = BASE[kind]
        found = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    each = [spans_of(kind) for kind in range(len(BASE))]
    return F.array_sort(F.concat(*each).cast(SPAN))


def labelled_samples(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(sample, random): what the base patterns find in a bounded sample of documents and digests of numbers as random, the documents' ASCII words
    and numbers as ordinary. Documents are drawn by the hash of their texts, whole."""
    spark = docs.sparkSession
    n = docs.count()
    part = int(min(1.0, settings.documents / max(1, n)) * (1 << 30))
    some = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1 << 30)) < part))
    def values(pattern: str, group: int, least: int) -> Column:
        return F.filter(matches(F.col("text"), pattern, group)["value"], lambda v: F.length(v) >= least)

    found = some.select(F.explode(F.concat(*[values(*b[1:]) for b in BASE])).alias("sample"))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("sample"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(settings.made).select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")))).alias("sample"))
    return found.union(made).select("sample", F.lit(1).alias("random")).union(words.select("sample", F.lit(0).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of ASCII character pairs (place 128 * first + second) from labelled ``samples`` (sample, random 0 or 1).

    Add-one smoothed transition frequencies of each class. Null and one-letter samples have no pairs; without samples every ratio is 0. Pairs are summed
    before the driver sees them: at most 128 * 128 of each class.
    """
    codes = F.transform(F.split("sample", ""), F.ascii)
    pairs = samples.where(F.col("sample").isNotNull() & F.col("random").isNotNull() & (F.length("sample") > 1)).select(
        (F.col("random") > 0).alias("random"), F.explode(once(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * 128 + b))).alias("pair"))
    rows = pairs.where("pair >= 0 and pair < 16384 and pair % 128 > 0").groupBy("random", "pair").count().collect()
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    totals = {True: [0] * 128, False: [0] * 128}
    for r in rows:
        counts[r["random"]][r["pair"]] = r["count"]
        totals[r["random"]][r["pair"] // 128] += r["count"]

    def log_p(of: bool, pair: int) -> float:
        return math.log((counts[of].get(pair, 0) + 1) / (totals[of][pair // 128] + 128))

    return [log_p(True, pair) - log_p(False, pair) for pair in range(128 * 128)]


def ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of an ASCII token: the sum over its character pairs."""
    def total(c: Column) -> Column:
        each = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(model, a * 128 + b))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

    return once(F.transform(F.split(token, ""), F.ascii), total)


def model_column(model: list[float]) -> Column:
    return F.split(F.lit(" ".join(map(repr, model))), " ").cast("array<double>")


def scan(docs: DataFrame, model: list[float], text: str = "text", base: str = "base", spans: str = "spans", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end), code points with the end exclusive, in order of start, then kind.

    ``base`` are the base patterns' finds, ``spans`` those and the tokens, or the parts of tokens outside base spans, of ``least_length`` letters or more whose
    ratio reaches ``least_ratio``. Whole texts, null as empty; a row depends on its text alone, without a shuffle; columns named like a result are replaced.
    """
    whole, llr = F.coalesce(F.col(text), F.lit("")), model_column(model)
    with_base = docs.withColumn(base, base_spans(whole))
    # with base spans blanked, the parts of tokens outside them are the tokens that are left
    rest = with_base.withColumn("__rest", replaced(whole, merged(F.col(base)), lambda n: F.repeat(F.lit(" "), n)))
    tokens = matches(F.col("__rest"), rf"[A-Za-z0-9+/_=-]{{{settings.least_length},}}")
    more = F.filter(tokens, lambda t: ratio(t["value"], llr) >= settings.least_ratio)
    added = F.transform(more, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end"))).cast(SPAN)
    return rest.withColumn(spans, F.array_sort(F.concat(F.col(base), added))).drop("__rest")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[secret]", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark``, overlapping spans by one; texts without a span stay as they are, null included."""
    found = scan(docs, model, text, "__base", "__spans", settings)
    clean = replaced(F.col(text), merged(F.col("__spans")), lambda n: F.lit(mark))
    return found.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))).select(*docs.columns)
